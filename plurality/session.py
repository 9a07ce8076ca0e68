"""Session helpers: a local session for tests/bench and a shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "plurality") -> SparkSession:
    """Session for tests and benchmarks. On a cluster use the cluster's session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PLURALITY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Only when the setting is absent (tests, local runs) a private folder is
    created and registered, so later calls reuse it.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf and not spark.sparkContext.getCheckpointDir():
        # set on the session after the context started: register it for checkpoint()
        spark.sparkContext.setCheckpointDir(conf)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or object storage)")
        # local runs and tests only: a private folder on this machine
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plurality-ckpt-"))
        conf = spark.sparkContext.getCheckpointDir()
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in this application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to ``scratch_path``s; results that read them must have been saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Largest size that is hinted for broadcast; above it the planner chooses
# (size statistics, AQE runtime statistics).
BROADCAST_MAX_BYTES = 64 << 20


def row_bytes(schema) -> int:
    """About how many bytes a row takes: 8 per fixed-width column, 64 per text or nested one."""
    from pyspark.sql import types as T

    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return 16 + sum(64 if isinstance(f.dataType, wide) else 8 for f in schema)


def bounded_broadcast(df, row_bound: int, max_bytes: int = BROADCAST_MAX_BYTES):
    """Broadcast hint only for a side whose row count is bounded by
    construction (rule size, catalog size, one row per choice), and only if
    that many rows of its schema are small."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if row_bound * row_bytes(df.schema) <= max_bytes else df
