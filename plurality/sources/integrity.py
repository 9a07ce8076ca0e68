"""File integrity in blocks.

A file is checked as ranges: every (file, block) is one row, dealt over the
cluster, read with a seek and hashed; a file's block digests are put in order
and hashed again. A large file is therefore read by many tasks and no task
holds more than a block, whatever the file's size. Where a manifest gives the
SHA-256 of the whole file, which cannot be combined from parts, a file is
streamed block by block by one task.

Sizes come from the file listing alone (no content is read), and only files
whose size agrees are opened.

Files are listed and opened in tasks through their URI (file:, hdfs:, s3: and
the like).
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def _store(uri: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def open_file(uri: str):
    """A seekable stream of a file in shared storage."""
    where, path = _store(uri)
    return where.open_input_file(path)


def listed_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, bytes) of a folder's files, empty ones too; listed by a task, contents are not read."""

    def run(batches: Iterator) -> Iterator:
        from fnmatch import fnmatchcase

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                where, root = _store(folder)
                found = [f for f in where.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern)]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{folder.rstrip('/')}/{f.base_name}" for f in part], pa.string()), pa.array([f.base_name for f in part], pa.string()),
                         pa.array([f.size for f in part], pa.int64())], ["path", "file_name", "bytes"])

    return spark.createDataFrame([(directory,)], "folder string").mapInArrow(run, "path string, file_name string, bytes long")


def block_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, sha256) of every block of ``files`` (path, bytes); an empty file has one empty block."""
    spark = files.sparkSession
    ranges = files.select("path", F.col("bytes").cast("long").alias("bytes"))
    ranges = ranges.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("bytes") / block_bytes) - 1, F.lit(0)).cast("long"))))
    # by (path, block), so that one file's blocks go to many tasks
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "block").sortWithinPartitions("path", "block")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            digests, at, stream = [], None, None
            try:
                for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    if path != at:
                        if stream is not None:
                            stream.close()
                        at, stream = path, open_file(path)
                    stream.seek(block * block_bytes)
                    digests.append(hashlib.sha256(stream.read(block_bytes)).hexdigest())
            finally:
                if stream is not None:
                    stream.close()
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(digests, pa.string())], ["path", "block", "sha256"])

    return ranges.select("path", "block").mapInArrow(run, "path string, block long, sha256 string")


def combined(digests: DataFrame) -> DataFrame:
    """(path, blocks, tree_sha256): the SHA-256 over the block digests in order (their hex texts, joined)."""
    in_order = F.sort_array(F.collect_list(F.struct("block", "sha256")))
    found = digests.groupBy("path").agg(in_order.alias("all"))
    return found.select("path", F.transform("all", lambda b: b["sha256"]).alias("blocks"),
                        F.sha2(F.array_join(F.transform("all", lambda b: b["sha256"]), ""), 256).alias("tree_sha256"))


def stream_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, sha256) of whole files, each streamed by one task."""
    spark = files.sparkSession

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            paths, out = batch.column("path").to_pylist(), []
            for path in paths:
                digest = hashlib.sha256()
                with open_file(path) as stream:
                    while block := stream.read(block_bytes):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.string())], ["path", "sha256"])

    paths = files.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return paths.mapInArrow(run, "path string, sha256 string")


def completeness(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Existence and size only: ``file_name, expected_bytes, bytes, status`` with ``ok``, ``missing``, ``unlisted`` or ``size_mismatch``."""
    m = manifest.select(F.col("file_name").alias("_m"), F.col("bytes").alias("expected_bytes"))
    out = m.join(files.select("file_name", "bytes"), F.col("_m") == F.col("file_name"), "full")
    status = (F.when(F.col("file_name").isNull(), "missing").when(F.col("_m").isNull(), "unlisted")
              .when(F.col("expected_bytes") != F.col("bytes"), "size_mismatch").otherwise("ok"))
    return out.select(F.coalesce("_m", "file_name").alias("file_name"), "expected_bytes", "bytes", status.alias("status"))


def audit_files(spark: SparkSession, manifest: DataFrame, directory: str, pattern: str = "*", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Files of a folder against a manifest: ``file_name, expected_bytes, bytes, status, bad_blocks``.

    ``manifest``: ``file_name, bytes`` and ``blocks`` (the SHA-256 of each block
    in order) or ``sha256`` (of the whole file). Status as in ``completeness``
    or ``hash_mismatch``; ``bad_blocks`` are the numbers of the blocks that
    differ (with ``blocks`` only). All failures are reported, not the first.
    """
    files = listed_files(spark, directory, pattern)
    sized = completeness(manifest, files)
    right = files.join(sized.where(F.col("status") == "ok").select("file_name"), "file_name", "left_semi")
    if "blocks" in manifest.columns:
        found = combined(block_digests(right, block_bytes)).join(right.select("path", "file_name"), "path").select("file_name", F.col("blocks").alias("_found"))
        both = found.join(manifest.select("file_name", "blocks"), "file_name")
        places = F.sequence(F.lit(0), F.greatest(F.size("_found"), F.size("blocks")) - 1)
        bad = F.filter(places, lambda i: ~F.get("_found", i).eqNullSafe(F.get("blocks", i)))
        both = both.select("file_name", bad.alias("bad_blocks"))
        wrong = F.size("bad_blocks") > 0
    else:
        found = stream_digests(right, block_bytes).join(right.select("path", "file_name"), "path").select("file_name", F.col("sha256").alias("_found"))
        both = found.join(manifest.select("file_name", "sha256"), "file_name")
        both = both.select("file_name", F.lit(None).cast("array<int>").alias("bad_blocks"), (~F.col("_found").eqNullSafe(F.col("sha256"))).alias("_wrong"))
        wrong = F.col("_wrong")
    both = both.withColumn("_wrong", F.coalesce(wrong, F.lit(True)))
    status = F.when((F.col("status") == "ok") & F.col("_wrong"), "hash_mismatch").otherwise(F.col("status"))
    return sized.join(both, "file_name", "left").select("file_name", "expected_bytes", "bytes", status.alias("status"),
                                                        F.when(F.col("_wrong"), F.col("bad_blocks")).alias("bad_blocks"))


def require_files(spark: SparkSession, manifest: DataFrame, directory: str, pattern: str = "*", block_bytes: int = BLOCK_BYTES) -> None:
    """Raises if a listed file is missing or differs; names the first of them (by name)."""
    wrong = audit_files(spark, manifest, directory, pattern, block_bytes).where(~F.col("status").isin("ok", "unlisted"))
    first = wrong.orderBy("file_name").limit(1).collect()
    if first:
        raise ValueError(f"manifest verification failed: {first[0].file_name}: {first[0].status}")


def write_files(records: DataFrame, directory: str) -> DataFrame:
    """Writes (file_name, content) rows as files of that name, one write per row; returns (file_name, bytes) as written.

    A file appears whole: it is written under another name and renamed, so a
    task that is run again replaces it with the same bytes.
    """

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        where, root = _store(directory)
        where.create_dir(root)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("file_name").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                part = f"{root}/.{name}.{uuid.uuid4().hex[:12]}"
                with where.open_output_stream(part) as out:
                    out.write(data)
                where.move(part, f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("file_name"), pa.array(sizes, pa.int64())], ["file_name", "bytes"])

    return records.select(F.col("file_name").cast("string").alias("file_name"), F.col("content").cast("binary").alias("content")).mapInArrow(
        run, "file_name string, bytes long")
