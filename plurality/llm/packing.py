"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit, largest sizes first. One round takes all documents
of one size. They and the open sequences ("gaps") are in sorted order, so a
document's successor is the tightest gap that holds it; documents that want
the same gaps are told apart by rank: the k-th document takes the k-th gap, and
as long as the size still fits into the gaps just used, these are the tightest
and take the next ranks. Gaps shrink by the size, and the round repeats while
gaps and documents are left; then new sequences are opened. This is best-fit
decreasing, document by document.

Gaps that have the same room are interchangeable and stand next to each other,
so the sorted gap list is kept run-length coded: at most ``capacity`` different
rooms, whatever the number of documents. The sweeps run on these runs and on
the count of documents per size (at most ``capacity`` numbers); the ranks, and
which document gets which place, are computed by Spark on the range-sorted
documents.

Cases: null text is empty (just the end id); null doc_ids and repeated rows
are packed like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut, ordered, table
from plurality.llm.tokens import encoder, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first rank, documents, first sequence, offset): the documents
    of a size with ranks from the first one on take consecutive sequences, one each.

    A gap is filled as often as the size fits before the next one is taken: what
    is left of it is tighter than any other gap that fits. So the result is that
    of best-fit decreasing, document by document.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    out, opened = [], 0

    def fill(size: int, rank: int, room: int, first: int, n: int, times: int) -> None:
        """``times`` documents into each of n gaps; the gaps' first documents have the first ranks."""
        out.extend((size, rank + j * n, n, first, capacity - room + j * size) for j in range(times))
        if left := room - times * size:
            gaps.setdefault(left, []).append((first, n))
            rooms[left] += n

    for size in sorted(counts, reverse=True):
        rank, wanting = 0, counts[size]

        def take(room: int, first: int, n: int) -> int:
            """Fills n gaps while documents are left; how many gaps were used."""
            nonlocal rank, wanting
            times = room // size
            full = min(n, wanting // times)
            if full:
                fill(size, rank, room, first, full, times)
            rank, wanting = rank + full * times, wanting - full * times
            if full < n and wanting:
                fill(size, rank, room, first + full, 1, wanting)
                rank, wanting, full = rank + wanting, 0, full + 1
            return full

        for room in (size + np.flatnonzero(rooms[size:])).tolist():
            while wanting and rooms[room]:
                first, n = gaps[room].pop()
                used = take(room, first, n)
                rooms[room] -= used
                if n > used:
                    gaps[room].append((first + used, n - used))
        if wanting:
            opened += take(capacity, opened, -(-wanting // (capacity // size)))
    return out


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. Only a document's first piece may be short of ``capacity`` when it is cut."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = encoder(vocabulary), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = codec.encode(text.as_py() or "") + end
                n = len(raw) // 4
                stop = (n - 1) % capacity + 1
                start, piece = 0, 0
                while start < n:
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``."""
    pieces = cut(pieces)
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sizes = sorted(counts)
    below = dict(zip(sizes, np.cumsum([0, *[counts[s] for s in sizes]]).tolist(), strict=False))
    # rows of the plan keyed by the document's position in the whole sorted order
    rows = sorted((below[size] + rank, first, offset) for size, rank, _, first, offset in plan(counts, capacity))
    at, first, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            k = np.searchsorted(at, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(first[k] + rank - at[k]), pa.array(offset[k])],
                [*names, "sequence_id", "offset"])

    keys = ["length", *[c for c in names if c != "length"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id long, offset long"
    return ordered(pieces.select(*names), keys).select(*names, "_rank").mapInArrow(assign, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(cut_documents(docs, tokenizer_path(VOCABULARY)))


def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
