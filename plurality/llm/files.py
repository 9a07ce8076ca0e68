"""Files in the cluster's shared folder, opened from tasks by their URI."""

from __future__ import annotations


def shared_files(uri: str):
    """(filesystem, path) of a folder or file: file:, hdfs:, s3: and the like, or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def own_name(prefix: str) -> str:
    """A name no other task attempt uses; only what a finished task reports is ever read."""
    import uuid

    from pyspark import TaskContext

    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    return f"{prefix}-{part:06d}-{uuid.uuid4().hex[:12]}"
