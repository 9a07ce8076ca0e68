"""Helpers shared by the operators: table reads, lineage cuts, distributed ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.session import scratch_path, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow table in the cluster's shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table written to the cluster's shared folder and read back.

    For steps with large shuffles: once the write has ended its shuffle files
    are removed, so a job's steps do not add up on the executors' disks.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Size of the files of a ``saved`` table."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table; whatever is still needed of it must have been saved since."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered(df: DataFrame, order: list, value: str | None = None) -> DataFrame:
    """Checkpointed rows of a narrow table with ``_rank`` (0-based position in
    the total order of ``order``) and, for ``value``, ``_before`` (its sum over
    all earlier rows).

    Rows are range-partitioned and sorted; positions inside a partition come
    from a window over the partition number, and the partitions' totals (one
    row per partition) give the offsets. No task sees more than its range.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = F.col(value).cast("long") if value else F.lit(0).cast("long")
    placed = cut(
        df.withColumn("_v", total)
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition, so one task and a broadcast are bounded
    starts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))) if value else placed.withColumn("_in", F.lit(0))
    return (
        out.join(F.broadcast(starts), "_part")
        .withColumn("_rank", F.col("_n0") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .withColumn("_before", F.col("_s0") + F.col("_in"))
        .drop("_v", "_mid", "_part", "_n0", "_s0", "_in")
    )
