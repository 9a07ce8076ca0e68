"""Removal of word runs that repeat an earlier document: seed and extend.

Seeds are winnowed anchors: of each window of SPAN words, the least hash of its
SEED-word grams. Equal windows have equal anchors, so a window can only repeat
where its anchor occurs in two documents. Anchors of one document are dropped
by an aggregation; around the others each document extends to the left and
right, word by word, to all windows that hold the anchor. The extensions of one
anchor meet in one place, where windows equal to one of a document with a
smaller id are marked. Overlapping marked windows join into maximal repeats,
and their words are removed. No pairs of documents are made: every window asks
only for the smallest id that has it.

Texts of equal words are settled first, by their hash: copies of an earlier
text of at least SPAN words lose all words. An anchor with many documents is
dealt out by document to several tasks; the smallest id per window is found in
each and then over all of them.

Windows are compared by 64-bit hash within the group of a 64-bit anchor hash.

Cases: null or empty text has no words; a null doc_id is compared as the
smallest id of all, so such rows keep their words; rows of equal doc_id are one
document to the others (neither is smaller) and each gets a result; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.llm.common import cut, saved, table
from plurality.llm.words import hashed, room, sliding, windows, winnow

SPAN, SEED = 50, 25
#: occurrences of one anchor that one task takes
ANCHOR_ROWS = 1000

KEY = ["id", "tie"]
SKETCH = "id long, tie long, s1 long, s2 long, n_words long, anchors array<long>"
EXTENSIONS = "anchor long, salt int, groups int, id long, tie long, at int, wins array<long>"


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _parts(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``id`` (doc_id, the smallest number for null) and ``tie`` (a hash of the text), by which rows are told apart."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))


def sketch(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """Per row: a 128-bit hash of its words, their number and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                out: list[list] = [[], [], [], []]
                for _, h, ends in hashed(_bytes(batch.column("text"))):
                    grams, left = windows(h, seed), room(ends, len(h))
                    chosen = winnow(grams, left[: len(grams)] - seed + 1, span - seed + 1)
                    starts = np.concatenate(([0], ends[:-1]))
                    cuts = np.searchsorted(chosen, np.stack((starts, ends)))
                    for a, b, c, d in zip(starts.tolist(), ends.tolist(), *cuts.tolist(), strict=True):
                        digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
                        out[0].append(int.from_bytes(digest[:8], "little", signed=True))
                        out[1].append(int.from_bytes(digest[8:], "little", signed=True))
                        out[2].append(b - a)
                        out[3].append(np.unique(grams[chosen[c:d]]).view(np.int64))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("tie"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                    ["id", "tie", "s1", "s2", "n_words", "anchors"])

    return docs.select("id", "tie", "text").mapInArrow(run, SKETCH)


def extend(texts: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """Windows around shared anchors. ``texts``: id, text, and ``shared``, the document's shared anchors with their number of task groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 64):
                ids, ties = batch.column("id").to_pylist(), batch.column("tie").to_pylist()
                out: list[list] = [[], [], [], [], [], [], []]
                for k, data in enumerate(_bytes(batch.column("text"))):
                    for _, h, _ends in hashed([data]):
                        if len(h) < span:
                            continue
                        least = sliding(windows(h, seed), span - seed + 1, np.minimum)
                        known = batch.column("shared")[k].values
                        anchors = known.field("anchor").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                        groups = known.field("groups").to_numpy(zero_copy_only=False)
                        order = np.argsort(anchors)
                        anchors, groups = anchors[order], groups[order]
                        hit = np.minimum(np.searchsorted(anchors, least), len(anchors) - 1)
                        marked = anchors[hit] == least
                        wins = windows(h, span, seed=1).view(np.int64)
                        # runs of neighbouring windows with the same anchor
                        edge = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1], [True])))
                        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                            if marked[a]:
                                n = int(groups[hit[a]])
                                row = (int(least[a].view(np.int64)), _spread(ids[k], n), n, ids[k], ties[k], a, wins[a:b])
                                for column, value in zip(out, row, strict=True):
                                    column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                                 ["anchor", "salt", "groups", "id", "tie", "at", "wins"])

    return texts.select("id", "tie", "text", "shared").mapInArrow(run, EXTENSIONS)


def _spread(doc: int, groups: int) -> int:
    return ((doc * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32) % groups


def repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """id, tie, copy, at: for each text that loses words, whether it is a copy
    that loses all, or else the sorted starts of its marked windows.
    """
    rows = keyed(docs.select("doc_id", "text"))
    known = cut(sketch(rows, span, seed).dropDuplicates(KEY))
    same = known.filter(F.col("n_words") >= span).groupBy("s1", "s2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    same = cut(same.filter("first < last").drop("last"))
    known = known.join(same, ["s1", "s2"], "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))

    seeds = known.filter("not copy").select("id", "tie", F.explode("anchors").alias("anchor"))
    shared = seeds.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    shared = saved(shared.filter("a < b").select("anchor", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("groups")), "anchors")
    per_doc = seeds.join(shared, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "groups")).alias("shared"))
    found = saved(extend(rows.join(per_doc, KEY), span, seed), "extensions")

    def spell(df: DataFrame) -> DataFrame:
        return df.select("anchor", "salt", "groups", "id", "tie", "at", F.posexplode("wins").alias("step", "win"))

    # ordinary anchors: all their windows meet in one task
    w = Window.partitionBy("anchor", "win")
    cool = spell(found.filter("groups = 1").repartition("anchor"))
    cool = cool.withColumn("least", F.min("id").over(w)).filter("id > least")
    # anchors of many documents: least id per window first, sent back to each of the anchor's groups
    warm = spell(found.filter("groups > 1"))
    least = warm.groupBy("anchor", "win", "groups").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    least = cut(least.select("anchor", "win", "least", F.explode(F.expr("sequence(0, groups - 1)")).alias("salt")))
    warm = warm.join(least, ["anchor", "salt", "win"]).filter("id > least")
    at = (F.col("at") + F.col("step")).alias("at")
    marks = cool.select(*KEY, at).unionByName(warm.select(*KEY, at))
    marks = marks.groupBy(*KEY).agg(F.sort_array(F.collect_set("at")).alias("at"))
    copies = known.filter("copy").select(*KEY, F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("at"))
    return copies.unionByName(marks.select(*KEY, F.lit(False).alias("copy"), "at"))


def covered(n: int, copy: bool, at: list[int] | None, span: int = SPAN) -> np.ndarray:
    """Mask of the words to remove."""
    if copy:
        return np.ones(n, dtype=bool)
    edges = np.zeros(n + 1, dtype=np.int64)
    if at is not None and len(at):
        starts = np.asarray(at, dtype=np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + span, -1)
    return np.cumsum(edges)[:n] > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without(data: bytes, copy: bool, at: list[int] | None, span: int = SPAN) -> bytes:
    """The text without its removed words (and the white space after each)."""
    if not copy and at is None:
        return data
    words = _WORD.findall(data)
    gone = covered(len(words), copy, at, span)
    return b"".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def remove_repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """The documents with their own columns, whatever their names; ``text`` without the repeated words (null stays null) and ``n_chars``, if there, its new length."""
    found = repeats(docs, span, seed)
    rows = docs.select(F.struct("*").alias("doc"))
    keys = keyed(rows.select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))).drop("doc_id", "text")
    joined = keys.join(found, KEY, "left").select("doc", "copy", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copy, at in zip(batch.column("doc").field("text"), batch.column("copy"), batch.column("at"), strict=True):
                out.append(None if not text.is_valid else without(text.as_py().encode(), bool(copy.as_py()), at.as_py(), span).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], ["doc", "left"])

    done = joined.mapInArrow(run, T.StructType([T.StructField("doc", joined.schema["doc"].dataType), T.StructField("left", T.StringType())]))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the words that stay, per row of ``docs``."""
    joined = keyed(docs.select("doc_id", "text")).join(repeats(docs, span, seed), KEY, "left").select("doc_id", "text", "copy", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, copy, at in zip(_bytes(batch.column("text")), batch.column("copy"), batch.column("at"), strict=True):
                words = text.split()
                gone = covered(len(words), bool(copy.as_py()), at.values.to_numpy() if at.is_valid else None, span)
                if gone.any():
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out[0].append(len(gone))
                out[1].append(int(gone.sum()))
                out[2].append(hashlib.sha256(b" ".join(words)).hexdigest())
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
