"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last WINDOW bytes has BITS zero bits,
so equal passages in different documents get equal chunks whatever stands
before them. A chunk that occurs at least twice in the corpus is encoded once,
in the document that has its smallest (document, place); the ids go to all its
other places. Other chunks are encoded where they stand.

Chunks may end inside a word, so their joins are repaired: the last units (a
word with the white space before it) of one chunk and the first of the next are
encoded together. If the outermost units come out as in the chunks' own
encodings, only the ids between them change; otherwise the window grows, at
last to both chunks whole.

Documents travel once, compressed, to the place where their chunks' ids meet
them. Chunk ids join by 128-bit hash; a chunk of very many documents is a
skewed equi-join, which adaptive execution splits.

Cases: null text is empty and has no ids; repeated rows each get their result;
a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import saved, table
from plurality.llm.tokens import UNIT, UnitEncoder, encoder, tokenizer_path
from plurality.llm.words import mix, powers

VOCABULARY = "word_bpe_49k.json"
WINDOW, BITS, LEAST, MOST = 32, 9, 256, 8192
BLOCK = 1 << 20
BASE = 0xD6E8FEB86659FD93

#: stands for a null doc_id, and is one
NO_ID = -(1 << 63)
PLACES = "row long, tie long, k int, d1 long, d2 long"
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _candidates(data: bytes) -> Iterator[int]:
    """Places after which the rolling hash allows a cut."""
    for at in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        raw = np.frombuffer(data, np.uint8, min(len(data) - at, BLOCK + WINDOW - 1), at).astype(np.uint64) + np.uint64(1)
        up, down = powers(BASE, len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * up, out=sums[1:])
        rolling = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(raw) - WINDOW + 1])
        yield from (np.flatnonzero(rolling >> np.uint64(64 - BITS) == 0) + (at + WINDOW)).tolist()


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of LEAST to MOST bytes (the last may be shorter), cut between characters."""
    cuts, last = [0], 0

    def close(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if at < len(data):
            cuts.append(at)
        return at

    for at in _candidates(data):
        while at - last > MOST:
            last = close(last + MOST)
        if at - last >= LEAST:
            last = close(at)
    while len(data) - last > MOST:
        last = close(last + MOST)
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)] if data else []


def _digest(chunk: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def repair(codec: UnitEncoder, left: list[str], spent: int, left_ids: bytes, right: list[str], right_ids: bytes) -> tuple[int, bytes, int, int] | None:
    """How the ids change where two chunks, given as units, meet: (bytes of ids
    to drop from the left's end, ids to put in between, bytes to drop from the
    right's start, right units used). None if the chunks must be encoded whole;
    ``spent`` units at the left's start belong to its own left join.
    """
    n = 2
    while n + spent <= len(left) and n <= len(right):
        ends, begins = left[-n:], right[:n]
        window = codec.encode("".join(ends + begins))
        own, other = codec.encode("".join(ends)), codec.encode("".join(begins))
        first, last = codec.encode(ends[0]), codec.encode(begins[-1])
        if (left_ids.endswith(own) and right_ids.startswith(other) and own.startswith(first) and other.endswith(last)
                and len(first) + len(last) <= len(window) and window.startswith(first) and window.endswith(last)):
            return len(own) - len(first), window[len(first) : len(window) - len(last)], len(other) - len(last), n
        n *= 2
    return None


def assemble(codec: UnitEncoder, parts: list[str], ids: list[bytes]) -> bytes:
    """Ids of the whole text from its chunks and their ids."""
    out: list[bytes] = []
    text, have, units, spent, skip = "", b"", [], 0, 0
    for part, own in zip(parts, ids, strict=True):
        following = UNIT.findall(part)
        fixed = repair(codec, units, spent, have, following, own) if text else None
        if fixed is None:
            # no join yet, or no agreement: both chunks as one
            text, have = (text + part, codec.encode(text + part)) if text else (part, own)
            units = UNIT.findall(text)
            continue
        drop, between, begin, used = fixed
        out += [have[skip : len(have) - drop], between]
        text, have, units, spent, skip = part, own, following, used, begin
    return b"".join(out) + have[skip:]


def keyed(docs: DataFrame) -> DataFrame:
    """row (doc_id, NO_ID for null), tie (a hash of the text) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("row"), F.xxhash64("text").alias("tie"),
                       F.coalesce("text", F.lit("")).alias("text"))


def _compressed(rows: DataFrame) -> DataFrame:
    """row, tie and the text as one zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(x.as_py()) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tie"), pa.array(packed, pa.binary())], ["row", "tie", "packed"])

    # the filter holds for all rows; with it both joins below have the same input, and share its exchange
    return rows.mapInArrow(run, "row long, tie long, packed binary").filter("row is not null and tie is not null")


def _places(rows: DataFrame) -> DataFrame:
    """row, tie, k and 128-bit hash of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                for row, tie, text in zip(batch.column("row").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                    for k, chunk in enumerate(chunks(text.as_py())):
                        for column, value in zip(out, (row, tie, k, *_digest(chunk)), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["row", "tie", "k", "d1", "d2"])

    return rows.mapInArrow(run, PLACES)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit bytes) and the decoded text of every row; see ``digests`` for the registered form."""
    return _assembled(docs, vocabulary, False)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of ids and decoded text of every row."""
    return _assembled(docs, vocabulary, True)


def _assembled(docs: DataFrame, vocabulary: str, hashes: bool) -> DataFrame:
    rows = keyed(docs.select("doc_id", "text"))
    # a row that is repeated has its chunks once; its copies meet their ids in the last join
    places = saved(_places(rows).dropDuplicates(["row", "tie", "k"]), "places")
    at = F.struct("row", "tie", "k")
    shared = places.groupBy("d1", "d2").agg(F.min(at).alias("own"), F.max(at).alias("last")).filter("own <> last")
    owned = saved(shared.select("own.row", "own.tie", "own.k", "d1", "d2"), "owned")
    texts = _compressed(rows)

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec, unpack = encoder(vocabulary), zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], []]
            for packed, mine in zip(batch.column("packed"), batch.column("mine"), strict=True):
                parts = chunks(unpack.decompress(packed.as_py()))
                for x in mine.as_py():
                    out[0].append(x["d1"])
                    out[1].append(x["d2"])
                    out[2].append(codec.encode(parts[x["k"]].decode()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["d1", "d2", "ids"])

    mine = owned.groupBy("row", "tie").agg(F.collect_list(F.struct("k", "d1", "d2")).alias("mine"))
    known = texts.join(mine, ["row", "tie"]).select("packed", "mine").mapInArrow(encode_owned, "d1 long, d2 long, ids binary")
    known = known.dropDuplicates(["d1", "d2"])  # the owner may be repeated
    given = places.join(known, ["d1", "d2"]).groupBy("row", "tie").agg(F.collect_list(F.struct("k", "ids")).alias("given"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec, unpack = encoder(vocabulary), zstandard.ZstdDecompressor()
        numbers = [str(i) for i in range(codec.size)]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: list[list] = [[], [], []]
                for packed, have in zip(batch.column("packed"), batch.column("given"), strict=True):
                    parts = [x.decode() for x in chunks(unpack.decompress(packed.as_py()))]
                    reused = {x["k"]: x["ids"] for x in have.as_py()} if have.is_valid else {}
                    raw = assemble(codec, parts, [reused.get(k) or codec.encode(x) for k, x in enumerate(parts)])
                    ids = np.frombuffer(raw, "<u4").tolist()
                    decoded = codec.lib.decode(ids, skip_special_tokens=False)
                    if hashes:
                        out[0].append(len(ids))
                        out[1].append(hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest())
                        out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        out[0].append(raw)
                        out[1].append(decoded)
                if hashes:
                    columns, names = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns, names = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    joined = texts.join(given, ["row", "tie"], "left").select(F.when(F.col("row") != NO_ID, F.col("row")).alias("doc_id"), "packed", "given")
    return joined.mapInArrow(finish, ROWS if hashes else "doc_id long, ids binary, decoded string")


def op2_chunk_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(VOCABULARY))
