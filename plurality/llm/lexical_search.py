"""Ranked lexical search: Block-Max MaxScore over sharded, compressed postings.

Every task cuts its documents into shards of at most SHARD_BYTES of text (a
longer document is a shard of its own), sorts a shard by doc_id and writes, per
term, its postings in blocks of BLOCK: gaps and counts, each in as few bytes as
the block needs. Beside them stand each block's last document and its peaks,
the (count, document length) pairs that no other pair of the block beats in
both. A posting's value grows with the count and falls with the length, so the
peaks give the block's exact maximum whatever the corpus statistics are; the
index needs no second pass when documents are added.

A search takes the postings of its own terms only, brings them together by
(shard, block of items) and runs MaxScore there, over windows of documents.
Lists are ordered by their bound; those whose bounds add up to no more than the
score of the last kept document are not essential: no document that is in these
alone can enter. The essential lists are scored in the window. For their
documents the block maxima of the other lists are added first, and a candidate
that cannot enter is rejected before those blocks are decompressed. A window
whose block maxima stay too low is passed without decompressing anything. Each
shard gives its best k per item; the shards' lists are merged by a ranking that
keeps k rows per item and task before anything is shuffled.

Scores are 64-bit integers: the sum over an item's distinct terms of
w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L,
w = floor(1000 ln((2 N + 2) / (2 df + 1))).

Cases: null and empty texts hold no terms and are never found, nor counted in
N; an item without terms, or whose terms no document holds, has no rows;
repeated documents are documents of their own and each is returned; a null
doc_id sorts after all others; equal (item_id, text) rows are one item, equal
item_ids with different texts are ranked apart; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import cut, saved, table

TOP = 50
SHARD_BYTES, BLOCK = 32 << 20, 128
#: items that one task searches at a time, documents of a window, decompressed blocks kept
ITEMS, WINDOW, KEPT_BLOCKS = 256, 2048, 8192

POSTINGS = ("shard long, term binary, df int, ids array<long>, lengths array<long>, last array<int>, start array<int>, "
            "peak_at array<int>, peak_tf array<int>, peak_n array<int>, body binary")
#: every byte but those of terms becomes a blank; A-Z become a-z
_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind))


def _narrow(values: np.ndarray) -> bytes:
    top = int(values.max())
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _shard(shard: int, docs: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: one with its documents (term null), one per term."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    names: dict[bytes, int] = {}
    codes: list[int] = []
    counts: list[int] = []
    sizes, lengths = [], []
    for _, text in docs:
        words = terms_of(text)
        found = Counter(words)
        codes.extend([names.setdefault(t, len(names)) for t in found])
        counts.extend(found.values())
        sizes.append(len(found))
        lengths.append(len(words))
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                        *[(c, pa.list_(pa.int32())) for c in ("last", "start", "peak_at", "peak_tf", "peak_n")], ("body", pa.binary())])
    head = {"shard": [shard], "ids": [[i for i, _ in docs]], "lengths": [lengths]}
    yield pa.RecordBatch.from_arrays([pa.array(head.get(f.name, [None]), f.type) for f in schema], schema=schema)
    if not codes:
        return
    code, tf = np.array(codes, np.int64), np.array(counts, np.int64)
    doc, n = np.repeat(np.arange(len(docs)), sizes), np.array(lengths, np.int64)
    order = np.argsort(code, kind="stable")
    code, tf, doc = code[order], tf[order], doc[order]
    df = np.bincount(code)
    place = np.arange(len(code)) - np.repeat(np.cumsum(df) - df, df)
    first = np.flatnonzero(place % BLOCK == 0)  # first posting of every block
    after = np.append(first[1:], len(code))
    before = np.concatenate(([-1], doc[:-1]))
    before[place == 0] = -1
    gaps, block = doc - before, np.repeat(np.arange(len(first)), after - first)
    # peaks: by falling count, those with a length below all earlier ones of the block
    best = np.lexsort((n[doc], -tf, block))
    least = np.minimum.accumulate(n[doc][best] - block[best] * (int(n.max()) + 1))
    peak = best[np.concatenate(([True], least[1:] < least[:-1]))]
    parts, width = [], np.zeros(len(first), np.int64)
    for b, (x, y) in enumerate(zip(first.tolist(), after.tolist(), strict=True)):
        g, t = _narrow(gaps[x:y]), _narrow(tf[x:y])
        parts.append(bytes((len(g) // (y - x), len(t) // (y - x))) + g + t)
        width[b] = len(parts[-1])
    blocks = -(-df // BLOCK)
    block_end = np.cumsum(blocks)
    begin = np.cumsum(width) - width
    start = begin - np.repeat(begin[block_end - blocks], blocks)
    peak_block = block[peak]
    peak_end = np.searchsorted(peak_block, block_end)
    peak_at = peak_block - np.repeat(block_end - blocks, np.diff(peak_end, prepend=0))
    low, terms = 0, list(names)
    for at in range(0, len(terms), 8192):
        to = min(len(terms), at + 8192)
        high, p0, p1 = int(block_end[to - 1]), int(peak_end[at - 1]) if at else 0, int(peak_end[to - 1])
        body = [b"".join(parts[int(e - k) : int(e)]) for e, k in zip(block_end[at:to], blocks[at:to], strict=True)]
        ends, peaks = block_end[at:to] - low, peak_end[at:to] - p0
        none = pa.nulls(to - at, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * (to - at), pa.int64()), pa.array(terms[at:to], pa.binary()), pa.array(df[at:to], pa.int32()), none, none,
             _lists(doc[after - 1][low:high], ends, pa.int32()), _lists(start[low:high], ends, pa.int32()),
             *[_lists(v[p0:p1], peaks, pa.int32()) for v in (peak_at, tf[peak], n[doc][peak])], pa.array(body, pa.binary())], schema=schema)
        low = high


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written as a table; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)
        held, size = [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                if held and size + len(text) > shard_bytes:
                    yield from _shard(next(number), held)
                    held, size = [], 0
                held.append((i, text))
                size += len(text) + 64
        if held:
            yield from _shard(next(number), held)

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS), "postings")


class Shard:
    """Postings of one shard, opened for searching."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.stats = ids, (n_docs, n_terms)
        self.m = self.norm(lengths)
        self.lists: dict[bytes, tuple] = {}
        self.open: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}

    def norm(self, n: np.ndarray) -> np.ndarray:
        docs, terms = self.stats
        if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
            n = n.astype(object)
        return (50 + 50 * n * docs // max(1, terms)).astype(np.int64)

    @staticmethod
    def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)

    def add(self, term: bytes, last, start, peak_at, peak_tf, peak_n, body: bytes) -> None:
        value = self.value(peak_tf.astype(np.int64), self.norm(peak_n.astype(np.int64)))
        most = np.maximum.reduceat(value, np.flatnonzero(np.diff(peak_at, prepend=-1)))
        self.lists[term] = (last.astype(np.int64), start, np.append(most, 0), body, int(most.max()))

    def block(self, term: bytes, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and values of one block, decompressed."""
        if (key := (term, b)) not in self.open:
            last, start, _, body, _ = self.lists[term]
            at, end = int(start[b]), int(start[b + 1]) if b + 1 < len(start) else len(body)
            g, t = body[at], body[at + 1]
            n = (end - at - 2) // (g + t)
            gaps = np.frombuffer(body, f"<u{g}", n, at + 2)
            tf = np.frombuffer(body, f"<u{t}", n, at + 2 + g * n).astype(np.int64)
            doc = np.cumsum(gaps.astype(np.int64)) + (int(last[b - 1]) if b else -1)
            if len(self.open) >= KEPT_BLOCKS:
                self.open.clear()
            self.open[key] = doc, self.value(tf, self.m[doc])
        return self.open[key]

    def search(self, terms: list[bytes], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, best first; equal scores in order of the documents."""
        lists = sorted((w * self.lists[t][4], t, w) for t, w in zip(terms, weights, strict=True) if t in self.lists)
        bound = np.cumsum([b for b, _, _ in lists])
        docs, scores, low = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for begin in range(0, len(self.m), WINDOW):
            stop = min(len(self.m), begin + WINDOW)
            # lists before this one cannot lift a document over the last kept score together
            essential = int(np.searchsorted(bound, low, side="right"))
            if essential == len(lists):
                break
            spans = []
            for _, t, w in lists:
                last, _, most, _, _ = self.lists[t]
                a, b = np.searchsorted(last, (begin, stop - 1))
                b = min(int(b) + 1, len(last))
                spans.append((int(a), b, w * int(most[a:b].max()) if a < b else 0))
            if sum(s[2] for s in spans) <= low:
                continue
            total = np.zeros(stop - begin, np.int64)
            for (a, b, _), (_, t, w) in zip(spans[essential:], lists[essential:], strict=True):
                for i in range(a, b):
                    doc, value = self.block(t, i)
                    x, y = np.searchsorted(doc, (begin, stop))
                    total[doc[x:y] - begin] += w * value[x:y]
            live = np.flatnonzero(total)
            others = lists[:essential][::-1]
            at = np.array([np.searchsorted(self.lists[t][0], live + begin) for _, t, _ in others], np.int64).reshape(len(others), len(live))
            most = np.array([w * self.lists[t][2][b] for (_, t, w), b in zip(others, at, strict=True)], np.int64).reshape(at.shape)
            for j, (_, t, w) in enumerate(others):
                able = total[live] + most[j:].sum(axis=0) > low
                live, at, most = live[able], at[:, able], most[:, able]
                for b in np.unique(at[j][most[j] > 0]).tolist():
                    doc, value = self.block(t, b)
                    mine = live[at[j] == b]
                    hit = np.searchsorted(doc, mine + begin)
                    found = doc[np.minimum(hit, len(doc) - 1)] == mine + begin
                    total[mine[found]] += w * value[hit[found]]
            live = live[total[live] > low]
            docs, scores = np.concatenate((docs, live + begin)), np.concatenate((scores, total[live]))
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            low = int(scores[-1]) if len(scores) == k else 0
        return docs, scores


def queries_of(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): one row per distinct (item_id, text) with its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py() or b""))) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return cut(distinct.mapInArrow(run, "item_id long, terms array<binary>").withColumn("item", F.monotonically_increasing_id()))


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of the index."""
    items, heads = queries_of(items), index.filter("term is null")
    stats = heads.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = stats.docs, stats.terms or 0
    parts = max(1, -(-items.count() // ITEMS))
    asked = items.select("item", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"), F.explode("terms").alias("term"))
    # the lists of the asked terms, each once per block of items that asks for it
    lists = index.filter("term is not null").join(asked.select("term", "part").distinct(), "term")
    df = index.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = asked.join(df, "term").withColumn("w", w).filter("w > 0")
    weighed = weighed.groupBy("item", "part").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    # a block of about ITEMS items goes to every shard, with the shard's documents
    asks = cut(weighed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("item", "terms"))).alias("asks")))
    heads = heads.withColumn("part", F.explode(F.expr(f"sequence(0, {parts - 1})"))).join(asks, "part")
    columns = ["term", "ids", "lengths", "last", "start", "peak_at", "peak_tf", "peak_n", "body"]
    empty = F.lit(None).cast(asks.schema["asks"].dataType)
    work = heads.select("shard", "part", "asks", *columns).unionByName(lists.select("shard", "part", empty.alias("asks"), *columns))
    # the head of a (shard, block) comes first
    work = work.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("term").isNotNull())

    def found(shard: Shard, asks: pa.Array) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for ask in asks:
            terms = ask["terms"].values
            docs, scores = shard.search(terms.field("term").to_pylist(), terms.field("w").to_pylist(), k)
            for column, values in zip(out, ([ask["item"].as_py()] * len(docs), shard.ids.take(pa.array(docs)).to_pylist(), scores.tolist()), strict=True):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, asks = None, None
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                r = dict(zip(batch.schema.names, row, strict=True))
                if r["asks"].is_valid:
                    if shard:
                        yield found(shard, asks)
                    shard, asks = Shard(r["ids"].values, r["lengths"].values.to_numpy(), n_docs, n_terms), r["asks"].values
                elif shard:
                    shard.add(r["term"].as_py(), *[r[c].values.to_numpy() for c in columns[3:8]], r["body"].as_py())
        if shard:
            yield found(shard, asks)

    best = work.mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
