"""Scans, sinks and file checks."""

from __future__ import annotations

from typing import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.session import scratch_path
from plurality.sources.catalogs import duplicate_attributes, read_catalog
from plurality.sources.integrity import audit_files, listed_files, open_file, stream_digests
from plurality.spec import Catalog


def scan_union(spark: SparkSession, paths: Sequence[str], merge_schema: bool = False) -> DataFrame:
    """Bag union of Parquet files in sorted path order, with each row's
    ``file_path`` and ``file_name``. ``merge_schema``: files with different
    columns are merged by name (missing columns are NULL), which reads every
    footer; otherwise the first file's columns are used."""
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*sorted(paths))
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))


#: rows of a row group
ROW_GROUP_ROWS = 100_000


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", row_group_bytes: int = 128 * 1024 * 1024,
                  row_group_rows: int = ROW_GROUP_ROWS) -> str:
    """Parquet sink; Spark's commit protocol makes the directory appear whole.
    A row group ends at ``row_group_rows`` rows, or before at ``row_group_bytes``."""
    (
        df.write.mode("overwrite")
        .option("compression", compression)
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.block.row.count.limit", str(row_group_rows))
        .parquet(path)
    )
    return path


def row_groups(spark: SparkSession, directory: str) -> DataFrame:
    """``file_name, row_group, rows, bytes, compression`` of every row group, read from the footers of a folder's Parquet files (a task per run of files)."""
    files = listed_files(spark, directory, "*.parquet").select("path", "file_name")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for path, name in zip(batch.column("path").to_pylist(), batch.column("file_name").to_pylist(), strict=True):
                with open_file(path) as stream:
                    footer = pq.read_metadata(stream)
                for i in range(footer.num_row_groups):
                    group = footer.row_group(i)
                    codecs = sorted({group.column(c).compression for c in range(group.num_columns)})
                    for column, value in zip(out, (name, i, group.num_rows, group.total_byte_size, ",".join(codecs)), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["file_name", "row_group", "rows", "bytes", "compression"])

    return files.mapInArrow(run, "file_name string, row_group int, rows long, bytes long, compression string")


def row_group_audit(groups: DataFrame, limit: int = ROW_GROUP_ROWS) -> DataFrame:
    """One row over ``row_groups``: ``rows, row_groups, compression, oversized`` (groups above the limit) and ``uneven`` (groups below it with another one after them in their file)."""
    last = Window.partitionBy("file_name")
    marked = groups.withColumn("_last", F.max("row_group").over(last))
    return marked.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("row_groups"), F.array_join(F.sort_array(F.collect_set("compression")), ",").alias("compression"),
        F.count_if(F.col("rows") > limit).alias("oversized"), F.count_if((F.col("rows") < limit) & (F.col("row_group") < F.col("_last"))).alias("uneven"))


def sink_roundtrip(spark: SparkSession, df: DataFrame, name: str = "sink", compression: str = "zstd") -> tuple[DataFrame, DataFrame]:
    """Writes to the shared folder, re-reads, and returns (rows, load summary)."""
    path = write_parquet(df, scratch_path(spark, name), compression)
    back = spark.read.parquet(path)
    summary = back.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(",".join(sorted(back.columns))).alias("attributes"),
        F.lit("parquet").alias("format"),
        F.lit(compression).alias("compression"),
        F.lit(path).alias("path"),
    )
    return back, summary


def spark_type_name(dt) -> str:
    return dt.simpleString()


def describe(spark: SparkSession, path: str) -> DataFrame:
    """(column_index, name, type) per column plus the row count of the file.
    The count of a Parquet scan with no columns is answered from footers."""
    df = spark.read.parquet(path)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    items = [
        F.struct(F.lit(i).alias("column_index"), F.lit(f.name).alias("name"), F.lit(spark_type_name(f.dataType)).alias("type"))
        for i, f in enumerate(df.schema.fields)
    ]
    return rows.select("rows", F.inline(F.array(*items)))


def file_digests(spark: SparkSession, directory: str, pattern: str = "*", with_hash: bool = True) -> DataFrame:
    """(path, file_name, bytes[, sha256]) of every file in ``directory`` matching ``pattern``; a file is streamed, never held whole."""
    files = listed_files(spark, directory, pattern)
    return files.join(stream_digests(files), "path") if with_hash else files


def manifest_audit(spark: SparkSession, manifest: DataFrame, directory: str, pattern: str = "*") -> DataFrame:
    """Every manifest entry (file_name, bytes, sha256) against the files:
    ``ok``, ``missing``, ``size_mismatch`` (hash not computed for it) or
    ``hash_mismatch``. All failures are reported, not only the first."""
    found = audit_files(spark, manifest, directory, pattern).where("status <> 'unlisted'")
    return found.select("file_name", "expected_bytes", F.col("bytes").alias("actual_bytes"), "status")


def record_manifest_audit(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Stored records against a manifest, both ``(name, bytes, sha256)``:
    ``name, expected_bytes, bytes, status`` with status ``ok``, ``missing``,
    ``unlisted``, ``size_mismatch`` or ``hash_mismatch``. One join of narrow
    rows; contents are hashed where they are read."""
    m = manifest.select(F.col("name").alias("_m"), F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("_expected"))
    out = m.join(records, m["_m"] == records["name"], "full")
    status = (
        F.when(F.col("name").isNull(), F.lit("missing"))
        .when(F.col("_m").isNull(), F.lit("unlisted"))
        .when(F.col("expected_bytes") != F.col("bytes"), F.lit("size_mismatch"))
        .when(F.col("_expected") != F.col("sha256"), F.lit("hash_mismatch"))
        .otherwise(F.lit("ok"))
    )
    return out.select(F.coalesce("_m", "name").alias("name"), "expected_bytes", "bytes", status.alias("status"))


def schema_readiness(df: DataFrame, catalog: Catalog, key: str = "unit_id") -> DataFrame:
    """Catalog attributes against the table's columns, with non-NULL counts
    from one aggregate pass. status: ok / missing_in_table / not_in_catalog."""
    cols = [c for c in df.columns if c != key]
    wanted = list(catalog.attributes)
    present = [a for a in wanted if a in cols]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(a)).alias(f"_nn_{a}") for a in present])
    items = []
    for a in sorted(set(wanted) | set(cols)):
        in_cat, in_tab = a in catalog.attributes, a in cols
        status = "ok" if in_cat and in_tab else ("missing_in_table" if in_cat else "not_in_catalog")
        nn = F.col(f"_nn_{a}") if a in present else F.lit(None).cast("bigint")
        items.append(
            F.struct(F.lit(a).alias("attribute"), F.lit(in_cat).alias("in_catalog"), F.lit(in_tab).alias("in_table"),
                     nn.alias("non_null"), F.lit(status).alias("status"))
        )
    return counts.select("n", F.inline(F.array(*items)))


def observed_dictionary(df: DataFrame, catalog: Catalog, key: str = "unit_id") -> DataFrame:
    """Declared catalog full-outer-joined to the values observed in the table.

    ``attribute, value, code (catalog position), domain, is_breakdown,
    is_segment, in_catalog, observed`` (rows holding the value). Observed
    counts are a partial aggregate over the unpivoted attributes, so the
    shuffle carries at most (attributes x distinct values) rows per task."""
    spark = df.sparkSession
    attrs = list(catalog.attributes)
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attrs])).alias("kv")
    ).select("kv.attribute", "kv.value").where(F.col("value").isNotNull())
    seen = long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("observed"))
    declared = catalog.to_frame(spark)
    joined = declared.join(seen, ["attribute", "value"], "full")
    return joined.select(
        "attribute", "value", "code", "domain", "is_breakdown", "is_segment",
        F.col("code").isNotNull().alias("in_catalog"),
        F.coalesce(F.col("observed"), F.lit(0).cast("bigint")).alias("observed"),
    )


def load_catalog_json(spark: SparkSession, index_path: str) -> tuple[DataFrame, DataFrame]:
    """A catalog's long dictionary ``(domain, attribute, code, value)``, unchecked, and the attributes
    that more than one domain declares. ``catalogs.load_catalog`` raises on these."""
    long = read_catalog(spark, index_path)
    return long.select("domain", "attribute", "code", "value"), duplicate_attributes(long)
