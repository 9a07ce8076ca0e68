"""Preparation plan: packed shards -> decoded wide table.

Composes the operators of this package in the order the workflow needs:
multi-file scan of the shards, encoding guard, selection of the catalog's
fields by id (all must exist in the encoding schema), wide decode of only
those fields, ZSTD Parquet sink in the shared folder, and a load summary
read back from what was written. One pass over the shards; no shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators.packed import Fields, check_encoding, decode_wide
from plurality.session import scratch_path
from plurality.sources.files import write_parquet


def select_fields(encoding: Fields, wanted: Sequence[str]) -> list[str]:
    """The wanted field ids in encoding order; all must exist."""
    names = [name for name, _ in encoding]
    missing = sorted(set(wanted) - set(names))
    if missing:
        raise ValueError(f"fields absent from the encoding schema: {missing}")
    keep = set(wanted)
    return [n for n in names if n in keep]


def prepare(spark: SparkSession, shards: Sequence[str] | DataFrame, encoding: Fields, wanted: Sequence[str],
            packing: str = "nibble", row_bytes: int | None = None, output: str | None = None,
            compression: str = "zstd") -> tuple[DataFrame, DataFrame]:
    """Decodes the wanted fields of packed shards into a wide table written
    as Parquet. Returns (table read back, one-row load summary with rows,
    attribute list, format, compression, path)."""
    row_bytes = (len(encoding) + 1) // 2 if row_bytes is None else row_bytes
    problems = check_encoding(packing, row_bytes, len(encoding))
    if problems:
        raise ValueError("; ".join(problems))
    selected = select_fields(encoding, wanted)
    packed = shards if isinstance(shards, DataFrame) else spark.read.parquet(*sorted(shards))
    decoded = decode_wide(packed, encoding, select=selected)
    path = write_parquet(decoded, output or scratch_path(spark, "prepared"), compression)
    back = spark.read.parquet(path)
    summary = back.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(",".join(sorted(selected))).alias("attributes"),
        F.lit("parquet").alias("format"),
        F.lit(compression).alias("compression"),
        F.lit(path).alias("path"),
    )
    return back, summary
