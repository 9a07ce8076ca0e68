"""Token-ID files: one zstandard frame per document and a seek table at the end.

Layout of a file, all numbers little-endian:

* per document one zstandard frame (content checksum on) of its ids as
  unsigned 32-bit integers;
* a skippable frame with the document ids: signed 64-bit each, then one byte
  each that is 1 where the id is null;
* the seek table, a skippable frame in zstandard's seekable format: compressed
  size, decompressed size and the low 32 bits of the XXH64 of the decompressed
  bytes per frame, then the frame count, a flag byte and the closing magic.

``read_file`` streams a file, ``read_documents`` fetches single documents by
seeking: it reads the tables and only the requested frames.

Cases: null text is empty (its ids are just the end id); null doc_ids come
first; rows of equal doc_id are ordered by their text and all kept; an empty
table gives no file and no rows; other columns are ignored. A document may
have up to 2^30 - 1 ids (the table's 32-bit sizes); more raise an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut, ordered, table
from plurality.llm.files import own_name, shared_files
from plurality.llm.tokens import encoder, tokenizer_path
from plurality.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FILE_BYTES = 128 << 20
#: fixed values of the zstandard seekable format
SKIPPABLE, IDS_SKIPPABLE, CLOSING = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHECKED = 0x80

MANIFEST = "part long, file long, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenFile:
    """Writer of one file."""

    def __init__(self, path: str, stream, level: int = 1):
        import zstandard

        self.path, self.stream, self.size, self.n_tokens = path, stream, 0, 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[bytes] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.zstd.compress(raw)
        self.stream.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), checksum(raw)))
        self.ids.append(doc_id)
        self.size += len(frame)
        self.n_tokens += len(raw) // 4

    def close(self) -> None:
        n = len(self.ids)
        ids = struct.pack(f"<{n}q", *[i or 0 for i in self.ids]) + bytes(i is None for i in self.ids)
        self.stream.write(struct.pack("<II", IDS_SKIPPABLE, len(ids)) + ids)
        seek = b"".join(self.table) + struct.pack("<IBI", n, CHECKED, CLOSING)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        self.stream.close()


def read_tables(source) -> tuple[list[int | None], list[tuple[int, int, int, int]]]:
    """Document ids, and (offset, compressed size, size, checksum) per frame, from an open file."""
    size = source.size()
    n, flags, closing = struct.unpack("<IBI", source.read_at(9, size - 9))
    if closing != CLOSING or flags != CHECKED:
        raise ValueError("no seek table")
    seek_bytes, id_bytes = 12 * n, 9 * n
    body = source.read_at(8 + id_bytes + 8 + seek_bytes, size - 9 - seek_bytes - 8 - id_bytes - 8)
    if struct.unpack_from("<II", body) != (IDS_SKIPPABLE, id_bytes):
        raise ValueError("no id table")
    ids = struct.unpack_from(f"<{n}q", body, 8)
    nulls = body[8 + 8 * n : 8 + id_bytes]
    frames, at = [], 0
    for packed, raw, check in struct.iter_unpack("<III", body[8 + id_bytes + 8 :]):
        frames.append((at, packed, raw, check))
        at += packed
    return [None if z else i for i, z in zip(ids, nulls, strict=True)], frames


def _frame(source, zstd, frame: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = frame
    raw = zstd.decompress(source.read_at(packed, at), max_output_size=size)
    if len(raw) != size or checksum(raw) != check:
        raise ValueError(f"damaged frame at {at}")
    return raw


def read_documents(uri: str, wanted: Iterable[int | None]) -> dict[int | None, list[bytes]]:
    """Ids (as bytes) of the wanted documents; only their frames are read and decompressed."""
    import zstandard

    fs, path = shared_files(uri)
    wanted, out = set(wanted), {}
    with fs.open_input_file(path) as source:
        ids, frames = read_tables(source)
        for doc_id, frame in zip(ids, frames, strict=True):
            if doc_id in wanted:
                out.setdefault(doc_id, []).append(_frame(source, zstandard.ZstdDecompressor(), frame))
    return out


def read_file(uri: str) -> Iterator[tuple[int | None, bytes]]:
    """All documents of a file in order, one frame in memory at a time."""
    import zstandard

    fs, path = shared_files(uri)
    with fs.open_input_file(path) as source:
        ids, frames = read_tables(source)
        zstd = zstandard.ZstdDecompressor()
        for doc_id, frame in zip(ids, frames, strict=True):
            yield doc_id, _frame(source, zstd, frame)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns their manifest (part, file, path, n_docs, n_tokens), in ascending doc_id order of (part, file).

    Texts are range-partitioned by doc_id; each task writes its range and
    starts another file beyond ``file_bytes``. Ties in doc_id are ordered, and
    split between tasks, by the text's hash.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("tie"))
    placed = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, end = encoder(vocabulary), struct.pack("<I", end_id)
        fs, root = shared_files(folder)
        part, done, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = own_name("tokens")
                    out = TokenFile(f"{folder.rstrip('/')}/{name}", fs.open_output_stream(f"{root.rstrip('/')}/{name}"))
                out.add(doc_id, codec.encode(text.as_py()) + end)
                if out.size >= file_bytes:
                    out.close()
                    done, out = [*done, out], None
        if out is not None:
            out.close()
            done.append(out)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(done), pa.int64()),
            "file": pa.array(range(len(done)), pa.int64()),
            "path": pa.array([f.path for f in done], pa.string()),
            "n_docs": pa.array([len(f.ids) for f in done], pa.int64()),
            "n_tokens": pa.array([f.n_tokens for f in done], pa.int64()),
        })

    # the manifest is the commit: files that no finished task reported are never read
    return cut(placed.select("doc_id", "text").mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = ordered(manifest, ["part", "file"], "n_tokens").select("path", F.col("_before").alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]

        def rows(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
                out: list[list] = [[], [], [], []]
                for doc_id, raw in read_file(path):
                    for column, value in zip(out, (doc_id, at, len(raw) // 4, zlib.crc32(raw)), strict=True):
                        column.append(value)
                    at += len(raw) // 4
                    if len(out[0]) >= 10_000:
                        yield rows(out)
                        out = [[], [], [], []]
                yield rows(out)

    return files.repartition(n, "path").mapInArrow(read, ROWS)


def op7_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, scratch_path(spark, "tokens"), tokenizer_path(VOCABULARY)))
