"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the
pairwise sum is computed as 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so a text costs its number of features times the rank.

Features: the text's words hashed to 2^WORD_BITS buckets (log counts, scaled to
length 1), statistics of the whole text, and its stored length in characters.
Language, source and ids are not used.

Fitting: AdaGrad on at most SAMPLE_PER_CLASS labelled documents of each class,
those with the smallest hash of their id. That bound is the only sample here;
class weights bring the labelled rows' own proportions back. Rows with
crc32(doc_id as text) mod FOLDS = 0 are held out of the fit.

Cases: null text is empty and is scored on its statistics; a null doc_id is
held out; several labels of one document count as the lowest; null labels do
not count; without labels of both classes the score is the share of good
labels (0.5 without labels); repeated rows are scored alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import table
from plurality.llm.words import hashed

WORD_BITS = 14
RANK = 8
SAMPLE_PER_CLASS = 4000
FOLDS = 5
THRESHOLD = 0.3
EPOCHS = 8
#: small samples get more epochs, up to this many mini-batches in all
STEPS = 1000

#: byte classes whose share of the text is a statistic
CLASSES = [b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:", b"\n", b" \t", b"\"'()[]{}/\\=+_@^~`-"]
N_STATS = len(CLASSES) + 6
N_FEATURES = (1 << WORD_BITS) + N_STATS


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def _statistics(data: bytes, n_words: int, distinct: int, n_chars: int | None) -> list[float]:
    size = max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [4 * (len(data) - len(data.translate(None, c))) / size for c in CLASSES]
    return [
        *shares,
        1.0,
        np.log1p(n_words) / 8,
        distinct / max(1, n_words),
        size / max(1, n_words) / 16,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(data) if n_chars is None else max(0, n_chars)) / 10,
    ]


def features(texts: list[bytes], n_chars: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows in runs of texts: feature numbers, values, and each row's end."""
    for at, h, ends in hashed(texts, lower=True):
        starts = np.concatenate(([0], ends[:-1]))
        row = np.repeat(np.arange(len(ends)), ends - starts)
        key, count = np.unique((row << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        owner = key >> WORD_BITS
        value = 1 + np.log(count)
        norm = np.sqrt(np.bincount(owner, value * value, minlength=len(ends)))
        value /= norm[owner]
        distinct = np.bincount(owner, minlength=len(ends))
        cuts = np.cumsum(distinct)
        stats = np.array([_statistics(texts[at + k], int(ends[k] - starts[k]), int(distinct[k]), n_chars[at + k])
                          for k in range(len(ends))]).reshape(len(ends), N_STATS)
        where = np.repeat(cuts, N_STATS)
        numbers = np.insert(key & ((1 << WORD_BITS) - 1), where, np.tile((1 << WORD_BITS) + np.arange(N_STATS), len(ends)))
        values = np.insert(value, where, stats.ravel())
        yield numbers, values, cuts + N_STATS * np.arange(1, len(ends) + 1)


class Machine:
    """Weights ``w`` (bias last) and factors ``v``."""

    def __init__(self, w: np.ndarray, v: np.ndarray):
        self.w, self.v = w, v

    def logits(self, numbers: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = np.concatenate(([0], ends[:-1]))
        xv = self.v[numbers] * values[:, None]
        linear = np.add.reduceat(self.w[numbers] * values, starts)
        pairs = np.add.reduceat(xv, starts) ** 2 - np.add.reduceat(xv * xv, starts)
        return self.w[-1] + linear + 0.5 * pairs.sum(axis=1)

    def scores(self, numbers: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(numbers, values, ends), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int | None = None,
        rate: float = 0.05, decay: float = 1e-4, seed: int = 7, batch: int = 64) -> Machine:
    """AdaGrad over mini-batches; ``rows`` are (feature numbers, values)."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(N_FEATURES + 1), rng.normal(0, 0.02, (N_FEATURES, RANK))
    gw, gv = np.full(N_FEATURES + 1, 1e-6), np.full((N_FEATURES, RANK), 1e-6)
    model = Machine(w, v)
    for _ in range(epochs or max(EPOCHS, -(-STEPS // -(-len(rows) // batch)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            numbers = np.concatenate([rows[i][0] for i in some])
            values = np.concatenate([rows[i][1] for i in some])
            ends = np.cumsum([len(rows[i][0]) for i in some])
            owner = np.repeat(np.arange(len(some)), np.diff(np.concatenate(([0], ends))))
            error = (model.scores(numbers, values, ends) - labels[some]) * weights[some] / len(some)
            sums = np.add.reduceat(v[numbers] * values[:, None], np.concatenate(([0], ends[:-1])))
            step = error[owner] * values
            used, slot = np.unique(numbers, return_inverse=True)
            grad = np.bincount(slot, step) + decay * w[used]
            grads = np.stack([np.bincount(slot, step * (sums[owner, f] - v[numbers, f] * values)) for f in range(RANK)], axis=1)
            grads += decay * v[used]
            gw[used] += grad * grad
            gv[used] += grads * grads
            w[used] -= rate * grad / np.sqrt(gw[used])
            v[used] -= rate * grads / np.sqrt(gv[used])
            bias = error.sum()
            gw[-1] += bias * bias
            w[-1] -= rate * bias / np.sqrt(gw[-1])
    return model


def _arrays(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine | float:
    """The fitted machine, or the share of good labels where one class is missing.

    Only labels of ids that ``docs`` has count, for the sample and for the
    classes' weights; an id that is repeated gives one row, that of its smallest text hash.
    """
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not counts.get(0) or not counts.get(1):
        return counts.get(1, 0) / total if total else 0.5
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    picked = [known.filter(F.col("quality") == c).orderBy(*by_hash).limit(per_class) for c in (0, 1)]
    # at most 2 * per_class ids and labels
    sample = F.broadcast(picked[0].unionByName(picked[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[bytes] = []
            values: list[bytes] = []
            for numbers, value, ends in features(_arrays(batch.column("text")), batch.column("n_chars").to_pylist()):
                ids += [x.astype("<i4").tobytes() for x in np.split(numbers, ends[:-1])]
                values += [x.astype("<f4").tobytes() for x in np.split(value, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())],
                                             ["quality", "numbers", "weights"])

    one = docs.join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), F.xxhash64("text")).alias("d"))
    rows = (one.select("d.text", "d.n_chars", "quality")
            .mapInArrow(run, "quality int, numbers binary, weights binary").collect())
    rows.sort(key=lambda r: (r["quality"], bytes(r["numbers"]), bytes(r["weights"])))
    if len({r["quality"] for r in rows}) < 2:
        return counts[1] / total
    found = {c: sum(r["quality"] == c for r in rows) for c in (0, 1)}
    weight = {c: counts[c] / total / (found[c] / len(rows)) for c in (0, 1)}
    return fit([(np.frombuffer(r["numbers"], "<i4"), np.frombuffer(r["weights"], "<f4").astype(float)) for r in rows],
               np.array([r["quality"] for r in rows], dtype=float), np.array([weight[r["quality"]] for r in rows]))


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """doc_id and score of every row."""
    if not isinstance(model, Machine):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))
    # the model has a fixed size, N_FEATURES * (RANK + 1) numbers
    w, v = model.w.astype("f4"), model.v.astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(w, v)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = [machine.scores(*x) for x in features(_arrays(batch.column("text")), batch.column("n_chars").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out).astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, "doc_id long, score double")


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chars.alias("n_chars"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = _inputs(docs)
    return (score(rows, train(rows, labels))
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted good, with their own columns; texts are not
    shuffled. Labels of one class (or none) say nothing about others: all stay."""
    rows = _inputs(docs)
    model = train(rows, labels)
    if not isinstance(model, Machine):
        return docs
    w, v = model.w.astype("f4"), model.v.astype("f4")
    has_chars = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(w, v)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                chars = batch.column("n_chars").to_pylist() if has_chars else [None] * batch.num_rows
                good = [machine.scores(*x) >= threshold for x in features(_arrays(batch.column("text")), chars)]
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_model(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels"))
