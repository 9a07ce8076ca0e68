"""Clustering around centroids with zone maps over a space-filling curve.

Vectors are put in the order of a Hilbert curve over the AXES components of the
largest variance and cut into blocks of BLOCK rows; a block keeps the least and
greatest value of every component (its box). For two centroids, the difference of a vector's
squared distances to them is linear in the vector, so its least value over a
box is a sum over components. A centroid that is farther than another one from
every point of the box is no candidate for the block. The block's vectors are
compared exactly with the candidates that are left; many blocks have few.

Blocks are written once; each round is one scan of them that sends a row per
task and centroid (count and component sums) to the next one. Only the
centroids (k rows) reach the driver and are sent to the tasks.

Components become integers floor(scale * x). Below 2^21 the arithmetic runs in
doubles, which then hold every intermediate integer exactly; blocks with larger
ones use Python integers, so results are exact for all finite values.

Cases: rows whose vector is null, has another length or holds a null or
non-finite component are left out; a null id starts no centroid, but its vector
is assigned; repeated rows are vectors of their own; with fewer than k vectors
(or ids) there are fewer centroids; without any, the result is empty; a
distance or inertia beyond 64 bits is null; other columns are ignored. A vector
that many rows hold is dealt to all partitions of its place on the curve.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import saved, table

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: rows of a block; components and bits of the curve (AXES * BITS at most 63)
BLOCK, AXES, BITS = 128, 10, 6
#: integers below this keep all sums of DIM products exact in doubles
EXACT = 1 << 21


def kept_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x): the vectors of ``dim`` finite components, as doubles."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(good, F.lit(False)))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each point (non-negative integers below 2^bits) on the Hilbert curve of its dimension."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): as doubles if small enough for exact sums, else as Python integers."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    if not q.size or np.abs(q).max() < EXACT:
        return q
    from fractions import Fraction

    return np.array([[scale * Fraction(v) // 1 for v in row] for row in x.tolist()], dtype=object)


def blocks(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """(ids, x, low, high): runs of neighbours on the curve with their boxes, written as a table."""
    spread = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    spread = spread.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_pop("v").alias("var"))
    axes = spread.orderBy(F.desc_nulls_last(F.nanvl("var", F.lit(None))), "i").limit(AXES).collect()
    lo, hi, at = np.array([r.lo for r in axes]), np.array([r.hi for r in axes]), [r.i for r in axes]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))[:, at]
            # halves keep the range finite for components of any size
            unit = (x / 2 - lo / 2) / np.maximum(hi / 2 - lo / 2, np.finfo(float).tiny)
            key = hilbert(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(key)], ["vec_id", "x", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                x = _matrix(part.column("x"))
                values = (part.column("vec_id"), *(pa.array(v) for v in (x.ravel(), x.min(axis=0), x.max(axis=0))))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
                yield pa.RecordBatch.from_arrays(lists, ["ids", "x", "low", "high"])

    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = vectors.mapInArrow(place, "vec_id long, x array<double>, key long")
    # the second sort key spreads equal vectors; it is the row's place in its input part
    dealt = placed.withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id())).repartitionByRange(n, "key", "salt")
    found = dealt.sortWithinPartitions("key", "salt").select("vec_id", "x").mapInArrow(gather, "ids array<long>, x array<double>, low array<double>, high array<double>")
    return saved(found, "zones")


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest (or tie with a smaller number) for a point of the box.

    d(x, c) - d(x, b) = |c|^2 - |b|^2 - 2 x (c - b) is least over the box where
    every x is at the end that its sign asks for.
    """
    middle = (low + high) // 2
    away = ((centres - middle) ** 2).sum(axis=1)
    best = int(np.argmin(away))
    step = centres - centres[best]
    least = (centres**2).sum(axis=1) - (centres[best] ** 2).sum() - 2 * np.where(step > 0, step * high, step * low).sum(axis=1)
    return np.flatnonzero(least <= 0)


def nearest(q: np.ndarray, box: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; ties: the smaller number."""
    if object in (q.dtype, centres.dtype):
        q, box, centres = (np.vectorize(int, otypes=[object])(a) for a in (q, box, centres))
    near = candidates(box[0], box[1], centres)
    c = centres[near]
    d = (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * q.dot(c.T)
    at = np.argmin(d.astype(object), axis=1) if d.dtype == object else np.argmin(d, axis=1)
    return near[at], d[np.arange(len(q)), at]


def _centres(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= EXACT for row in rows for v in row)
    if not big:
        return np.array(rows, dtype=float)
    return np.array([[int(v) for v in row] for row in rows], dtype=object)


def _each(batches: Iterator[pa.RecordBatch], scale: int):
    """(ids, integer vectors, integer box) of every block."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            ids, x, low, high = (v.values for v in row)
            yield ids, integers(x.to_numpy().reshape(len(ids), -1), scale), integers(np.stack((low.to_numpy(), high.to_numpy())), scale)


def totals(zones: DataFrame, centres: list[list[int]], scale: int) -> DataFrame:
    """Per task and centroid: cluster, n, distance and component sums as decimal text (exact at any size)."""
    at = _centres(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = [0] * len(at), [0] * len(at)
        sums: list = [0] * len(at)
        for _, q, box in _each(batches, scale):
            number, d = nearest(q, box, at)
            for c in np.unique(number).tolist():
                mine = number == c
                n[c] += int(mine.sum())
                far[c] += int(d[mine].sum())
                sums[c] = sums[c] + np.array([int(v) for v in q[mine].sum(axis=0)], dtype=object)
        used = [c for c in range(len(at)) if n[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()), pa.array([str(far[c]) for c in used], pa.string()),
             pa.array([[str(v) for v in sums[c]] for c in used], pa.list_(pa.string()))], ["cluster", "n", "far", "sums"])

    def add(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        sums = [sum(map(int, column)) for column in zip(*part["sums"], strict=True)]
        return pd.DataFrame({"cluster": [key[0]], "n": [part["n"].sum()], "far": [str(sum(map(int, part["far"])))], "sums": [[str(s) for s in sums]]})

    kind = "cluster int, n long, far string, sums array<string>"
    return zones.mapInArrow(run, kind).groupBy("cluster").applyInPandas(add, kind)


def first_centres(vectors: DataFrame, k: int, rounds_of: str, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their id, in that order."""
    start = vectors.withColumn("h", F.sha2(F.concat(F.lit(rounds_of), F.col("vec_id").cast("string")), 256)).filter("h is not null")
    rows = start.orderBy("h", "x").limit(k).collect()  # k rows
    return [[int(v) for v in integers(np.array([r.x]), scale)[0]] for r in rows]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector, and the final centroids."""
    spark, kept = vectors.sparkSession, kept_vectors(vectors, dim)
    result = "vec_id long, cluster int, distance long"
    centres = first_centres(kept, k, "1:", scale)
    if not centres:
        empty = spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty, []
    zones = blocks(kept)
    for _ in range(rounds):
        for r in totals(zones, centres, scale).collect():  # k rows
            centres[r.cluster] = [int(s) // r.n for s in r.sums]
    at = _centres(centres)
    top = (1 << 63) - 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q, box in _each(batches, scale):
            number, d = nearest(q, box, at)
            far = [int(v) if v <= top else None for v in d.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    last = {r.cluster: int(r.far) for r in totals(zones, centres, scale).collect()}  # k rows
    whole = sum(last.values())
    rows = [(c, far if far <= top else None, whole if whole <= top else None, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
            for c, far in last.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return zones.mapInArrow(assign, result).join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centres


def op11_centroid_clustering(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))[0]
