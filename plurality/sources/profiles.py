"""Unit profiles: one row per unit, a string key and categorical attributes.

The engine works on any DataFrame of that shape (a decoded wide table in
production). These builders derive such tables from the star-schema test
data so every query's work grows with the underlying tables.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions.hashing import bucket_of_digest


# Columns (and types) the profiles read from each test table. A declared
# schema skips footer reads at planning time; Parquet matches columns by name
# and the scan still reads only these.
TABLE_COLUMNS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_orderstatus STRING",
    "lineitem": "l_orderkey BIGINT, l_returnflag STRING",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "documents": "doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """A test table; with ``schema`` (DDL, a subset of its columns) no footer
    is read to infer it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _known(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name, TABLE_COLUMNS[name])


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: region, segment, priority, status, basket, returned.

    lineitem is aggregated per order first (partial aggregation before the
    shuffle, so a hot order key is combined map-side) and joined on the order
    key. Nation and region are tiny dimension tables; the planner broadcasts
    them from their measured size (autoBroadcastJoinThreshold).
    """
    li = _known(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
    )
    o = _known(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    cu = _known(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = _known(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = _known(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = cu.join(n, cu.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    joined = o.join(geo, o.o_custkey == geo.c_custkey).join(li, o.o_orderkey == li.l_orderkey, "left")
    basket = (
        F.when(F.col("n_lines").isNull(), F.lit(None).cast("string"))
        .when(F.col("n_lines") <= 2, "small")
        .when(F.col("n_lines") <= 5, "medium")
        .otherwise("large")
    )
    returned = F.when(F.col("n_ret").isNull(), F.lit(None).cast("string")).when(F.col("n_ret") > 0, "Y").otherwise("N")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("unit_id"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        basket.alias("basket"),
        returned.alias("returned"),
    )


def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; quality/toxicity are NULL where no label exists."""
    d = _known(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = _known(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").cast("string").alias("unit_id"),
        F.col("lang"),
        F.col("source"),
        F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long").alias("length_band"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("quality"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("toxicity"),
    )


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units; every seventh has no key (like ``packed_profile``'s record ids)."""
    docs = table(spark, sf_dir, "documents", "doc_id BIGINT, lang STRING, n_chars BIGINT")
    labels = table(spark, sf_dir, "labels", "doc_id BIGINT, quality INT").select("doc_id", "quality")
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    key = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return docs.join(labels, "doc_id", "left").select(key.alias("unit_id"), "lang", band.alias("length_band"), quality.alias("quality"))


def packed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows derived from documents: 16-byte attribute blobs (32 nibble
    fields), some 2-byte short blobs, 4-byte null bitmaps, override lists with
    duplicate and NULL entries, and NULL record ids."""
    d = _known(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sid = F.col("doc_id").cast("string")
    ov_dup = F.array(
        F.struct(F.lit(3).alias("field_index"), F.concat(F.lit("ov"), F.col("lang")).alias("value")),
        F.struct(F.lit(3).alias("field_index"), F.lit("second").alias("value")),
    )
    ov_null = F.array(
        F.struct(F.lit(0).alias("field_index"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit(9).alias("field_index"), F.lit("x").alias("value")),
    )
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("d"), sid)).alias("source_record_id"),
        "source",
        F.col("doc_id").alias("source_row_index"),
        F.when(F.col("doc_id") % 11 == 0, F.unhex(F.substring(F.md5(sid), 1, 4))).otherwise(F.unhex(F.md5(sid))).alias("attributes"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("binary"))
        .otherwise(F.unhex(F.substring(F.md5(F.concat(F.lit("n"), sid)), 1, 8)))
        .alias("null_bitmap"),
        F.when(F.col("doc_id") % 3 == 0, ov_dup).when(F.col("doc_id") % 3 == 1, ov_null).alias("attribute_overrides"),
    )


#: fields and bytes of a row of the wide packed fixture
WIDE_FIELDS, WIDE_BYTES = 1290, 645


def wide_packed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed_profile`` at full width: 645-byte blobs (100 bytes in every 11th
    row), 162-byte null bitmaps and overrides at both ends of the fields."""
    d = _known(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sid = F.col("doc_id").cast("string")
    code = F.concat(*[F.md5(F.concat(sid, F.lit(f":{i}"))) for i in range(-(-WIDE_BYTES // 16))])
    bits = F.concat(*[F.md5(F.concat(sid, F.lit(f":n{i}"))) for i in range(11)])
    entry = lambda i, v: F.struct(F.lit(i).alias("field_index"), v.cast("string").alias("value"))
    lists = (F.when(F.col("doc_id") % 3 == 0, F.array(entry(3, F.concat(F.lit("ov"), F.col("lang"))), entry(3, F.lit("second")), entry(1285, F.lit("end"))))
             .when(F.col("doc_id") % 3 == 1, F.array(entry(0, F.lit(None)), entry(0, F.lit("late")), entry(5, F.lit("x")))))
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("d"), sid)).alias("source_record_id"),
        "source", F.col("doc_id").alias("source_row_index"),
        F.unhex(F.substring(code, F.lit(1), F.when(F.col("doc_id") % 11 == 0, 200).otherwise(2 * WIDE_BYTES))).alias("attributes"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("binary")).otherwise(F.unhex(F.substring(bits, F.lit(1), F.lit(324)))).alias("null_bitmap"),
        lists.alias("attribute_overrides"),
    )


def wide_selection() -> list[str]:
    """513 of the wide fixture's fields, even and odd ones."""
    return [f"f{i}" for i in range(WIDE_FIELDS) if i * 513 % WIDE_FIELDS < 513]


def packed_dictionary(n_fields: int = 32) -> list[tuple[str, list[str]]]:
    """Encoding schema of the packed fixture: field i is ``f{i}`` with
    ``4 + i % 13`` values ``f{i}v{j}`` (codes past the list decode to NULL)."""
    return [(f"f{i}", [f"f{i}v{j}" for j in range(4 + i % 13)]) for i in range(n_fields)]


def synthetic_profile(keys: DataFrame, attributes: dict[str, Sequence[str]], key: str = "unit_id") -> DataFrame:
    """Attributes assigned by hash: ``values[md5_lo64(key ':' attr) % k]``.

    ``keys`` is any key DataFrame (``spark.range(n)`` turned into
    ``'demo-' || id`` for demo runs, or the keys of a real table)."""
    names = list(attributes)
    digests = keys.select(
        F.col(key), *[F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + n))).alias(f"_d{i}") for i, n in enumerate(names)]
    )
    cols = [
        F.get(F.array(*[F.lit(v) for v in attributes[n]]), bucket_of_digest(F.col(f"_d{i}"), len(attributes[n]))).alias(n)
        for i, n in enumerate(names)
    ]
    return digests.select(F.col(key), *cols)


def demo_keys(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("demo-"), F.col("id").cast("string")).alias("unit_id"))


def demo_profile(spark: SparkSession, rule, catalog, n: int = 10_000) -> DataFrame:
    """Demo units ``demo-<i>`` for i < n with every attribute the rule needs
    (result groups and factors) drawn from its catalog list by hash; never
    NULL. Distributed by ``spark.range``."""
    attrs = {a: catalog.values(a) for a in rule.needed_attributes()}
    return synthetic_profile(demo_keys(spark, n), attrs)


def wide_profile(spark: SparkSession, paths: Sequence[str] | str, attributes: Sequence[str], key: str = "persona_id") -> DataFrame:
    """A processed wide table (one key column and many string attributes)
    read with only the key and the given attributes: the scan's ReadSchema
    holds just those columns, whatever the table's width."""
    paths = [paths] if isinstance(paths, str) else sorted(paths)
    df = spark.read.parquet(*paths)
    return df.select(F.col(key).alias("unit_id"), *sorted(set(attributes)))
