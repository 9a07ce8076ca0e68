"""Incremental scoring of arriving Parquet shards (Structured Streaming).

Row scoring is stateless, so the same expressions run on a streaming
DataFrame. ``running_shares`` keeps per-choice sums in the streaming state
store (one small row of state: count and C sums) and emits the updated
shares after each micro-batch; the checkpoint lives in the shared folder so a
restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plurality.operators import scoring
from plurality.operators.shares import long_by_choice, pct
from plurality.session import scratch_path
from plurality.spec import Rule


def shard_stream(spark: SparkSession, directory: str, schema: StructType, max_files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files under ``directory`` as a stream (schema is required)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(directory)


def running_shares(stream: DataFrame, rule: Rule, digits: int = 6) -> DataFrame:
    """Streaming aggregate: n and per-choice totals over all rows seen so far,
    reshaped to ``choice_index, choice, n, total, percent``."""
    scored = scoring.probabilities(stream, rule, keep=[])
    totals = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"t{i}") for i in range(len(rule.choices))])
    long = long_by_choice(totals, rule.choice_ids, "t", keep=["n"])
    return long.select(
        "choice_index", "choice", "n", F.round("total", digits).alias("total"),
        F.round(pct(F.col("total"), F.col("n")), digits).alias("percent"),
    )


def start_running_shares(spark: SparkSession, stream: DataFrame, rule: Rule, query_name: str,
                         checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the running-shares query into an in-memory table ``query_name``
    (complete mode). ``available_now`` processes what is there and stops."""
    writer = (
        running_shares(stream, rule).writeStream.outputMode("complete").format("memory").queryName(query_name)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{query_name}"))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_scored_sink(spark: SparkSession, stream: DataFrame, rule: Rule, output: str, checkpoint: str | None = None,
                      keep: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Scores every arriving row (stateless) and appends ``unit_id, keep...,
    p0..`` to a Parquet directory; the file sink with its checkpoint in the
    shared folder commits each micro-batch exactly once."""
    scored = scoring.probabilities(stream, rule, keep=[] if keep is None else keep)
    writer = (
        scored.writeStream.outputMode("append").format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-scored"))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
