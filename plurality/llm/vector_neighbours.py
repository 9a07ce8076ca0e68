"""Near duplicates among embeddings: a navigable small-world graph per shard.

Equal vectors are one node with a weight. Nodes are dealt to shards by hash;
each shard becomes a hierarchical navigable small-world graph: layer l holds
every 16^l-th node, each node keeps links to near nodes in differing directions,
and a search walks greedily through the upper layers and with a beam through
the lowest. A graph is a file in the cluster's shared folder. Every shard's
nodes query every shard's graph, in slices, so a task holds one graph and one
slice. A query whose beam is full of matches is repeated with a wider one (and in
the end compared with the whole shard, in blocks), and before a shard is accepted an audit compares beam results with brute force on
queries drawn from it and widens the beam until RECALL is reached (at the size
of the shard the beam is brute force itself).

Matches are verified by cosine in double precision; a task reduces its links to
a spanning forest, and the components are found by contraction. All pairs with a
link lie inside a component, so links are counted there exactly, in blocks; a
link that the graphs missed is still counted when its ends hang together by
others. In a large component, vectors within half the angle of the threshold of
its mean are linked with each other by the triangle inequality: they are counted
without being compared, so a hot group of copies costs no pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing (component: their own id); vectors of different lengths do
not link; equal rows are linked with each other; a null id takes part, but names
a component only if it has no other id (then null); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut, saved, table
from plurality.llm.components import components
from plurality.llm.files import own_name, shared_files
from plurality.session import scratch_path

THRESHOLD = 0.9
#: shards: at least MIN_SHARDS, and so many that none has more than about SHARD_ROWS nodes
MIN_SHARDS, SHARD_ROWS = 8, 50_000
#: links of a node (twice as many on the lowest layer), beam while building, first beam of a search
LINKS, BUILD_BEAM, BEAM = 12, 40, 24
#: share of an audit's true matches that the beam must find; queries of an audit
RECALL, AUDIT = 0.99, 256
#: queries that walk together, queries of a task, members of a block when links are counted
LOCKSTEP, SLICE, MEMBERS = 256, 4096, 512
#: keys under which a large component's members are dealt
SALTS = 64
#: a query whose beam was full is answered by comparing all of the shard once its beam is this part of it: that is cheaper than the walk
SCAN = 128
#: single precision may miss the threshold by this
SLACK = 1e-5


class Graph:
    """Nodes in insertion order; layer l holds the first ones, n >> 4 l of them."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        x = np.ascontiguousarray(x, np.float32)
        sizes = [len(x)] + [n for n in (len(x) >> (4 * i) for i in range(1, 8)) if n >= 8]
        graph = cls(x, [np.full((n, LINKS * (2 if i == 0 else 1)), -1, np.int32) for i, n in enumerate(sizes)])
        at = min(len(x), sizes[-1], LOCKSTEP)
        graph._insert(0, at)
        while at < len(x):
            # a batch ends where a layer does, and is not larger than what is there already
            stop = min([at + min(at, LOCKSTEP)] + [n for n in sizes if n > at])
            graph._insert(at, stop)
            at = stop
        return graph

    def _insert(self, first: int, stop: int) -> None:
        new = np.arange(first, stop)
        q = self.x[first:stop]
        near = q @ q.T
        np.fill_diagonal(near, -2)
        most = min(BUILD_BEAM, len(new))
        own = np.argpartition(-near, most - 1, axis=1)[:, :most]
        own_sim = np.take_along_axis(near, own, 1)
        own = np.where(own_sim > -2, own + first, -1).astype(np.int32)
        entry = np.zeros((len(new), 1), np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            member = stop <= len(self.layers[layer])
            if not member:
                entry = self.walk(q, 1, layer, entry)[0]
                continue
            ids, sims = own, own_sim
            if first:
                ids, sims = self.walk(q, BUILD_BEAM, layer, entry)
                entry = ids[:, :1]
                ids, sims = np.concatenate((ids, own), 1), np.concatenate((sims, own_sim), 1)
            self._link(layer, new, ids, sims)

    def _link(self, layer: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.layers[layer]
        links[new] = self._spread(ids, sims, links.shape[1])
        # the other direction: targets choose again among their links and the new ones
        source = np.repeat(new, links.shape[1])
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sim = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sim, target))
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        keep = place < links.shape[1]
        source, target, place = source[keep], target[keep], place[keep]
        nodes, row = np.unique(target, return_inverse=True)
        for at in range(0, len(nodes), 1024):
            part = nodes[at : at + 1024]
            mine = (row >= at) & (row < at + len(part))
            more = np.full((len(part), int(place[mine].max()) + 1), -1, np.int32)
            more[row[mine] - at, place[mine]] = source[mine]
            more[(more[:, :, None] == links[part][:, None, :]).any(axis=2)] = -1
            every = np.concatenate((links[part], more), 1)
            sim = np.einsum("ijk,ik->ij", self.x[every], self.x[part])
            full = (every >= 0).sum(axis=1) > links.shape[1]
            sim[every < 0] = -2
            rank = np.argsort(-sim, axis=1)
            links[part] = np.take_along_axis(every, rank, 1)[:, : links.shape[1]]
            if full.any():
                links[part[full]] = self._spread(every[full], sim[full], links.shape[1])

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates: nearest first, those nearer to the node than to all chosen ones; the rest fills up."""
        order = np.argsort(-np.where(ids >= 0, sims, -2), axis=1)[:, : BUILD_BEAM + LINKS]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), most), -1, np.int32)
        for at in range(0, len(ids), 128):
            i, s = ids[at : at + 128], sims[at : at + 128]
            v = self.x[i]
            between = v @ v.transpose(0, 2, 1)
            valid = i >= 0
            chosen = np.zeros_like(valid)
            worst = np.full(i.shape, -2, np.float32)  # similarity to the nearest chosen one
            for j in range(i.shape[1]):
                take = valid[:, j] & (worst[:, j] < s[:, j]) & (chosen.sum(axis=1) < most)
                chosen[:, j] = take
                worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
            # chosen first, then the other valid ones, each by similarity
            rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
            picked = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(i, rank, 1), -1)
            out[at : at + 128, : picked.shape[1]] = picked
        return out

    def walk(self, q: np.ndarray, beam: int, layer: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``beam`` nearest nodes found for every query, nearest first; -1 and -2 where there are fewer."""
        links, rows = self.layers[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(links)), bool)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -2, np.float32)
        done = np.ones((len(q), beam), bool)
        start = entry[:, :beam]
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("ijk,ik->ij", self.x[start], q), -2)
        done[:, : start.shape[1]] = start < 0
        seen[rows[:, None], np.where(start >= 0, start, start[:, :1])] = True
        while len(rows):
            # of each query the nearest node that was not expanded
            open_sims = np.where(done[rows], -3, sims[rows])
            best = np.argmax(open_sims, axis=1)
            going = open_sims[np.arange(len(rows)), best] > -3
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            done[rows, best] = True
            next_ = links[ids[rows, best]]
            fresh = (next_ >= 0) & ~seen[rows[:, None], next_]
            r, c = np.nonzero(fresh)
            to = next_[r, c]
            seen[rows[r], to] = True
            sim = np.full(next_.shape, -2, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", self.x[to], q[rows[r]])
            every = np.concatenate((sims[rows], sim), 1)
            rank = np.argpartition(-every, beam - 1, axis=1)[:, :beam] if every.shape[1] > beam else np.argsort(-every, axis=1)
            sims[rows] = np.take_along_axis(every, rank, 1)
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], np.where(fresh, next_, -1)), 1), rank, 1)
            done[rows] = np.take_along_axis(np.concatenate((done[rows], ~fresh), 1), rank, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def near(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found with a similarity of at least ``least``; full beams are widened."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), LOCKSTEP):
            left = np.arange(at, min(len(q), at + LOCKSTEP))
            width = beam
            while len(left):
                if 4 * width >= len(self.x) or width > beam and SCAN * width >= len(self.x):
                    r, c = np.nonzero(q[left] @ self.x.T >= least)
                    out.append((left[r], c))
                    break
                entry = np.zeros((len(left), 1), np.int32)
                for layer in range(len(self.layers) - 1, 0, -1):
                    entry = self.walk(q[left], 4, layer, entry)[0]
                ids, sims = self.walk(q[left], width, 0, entry)
                full = sims[:, -1] >= least
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                out.append((left[r], ids[r, c]))
                left, width = left[full], 4 * width
        pairs = [np.concatenate(p) for p in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 2
        return pairs[0], pairs[1]

    def audit(self, least: float) -> tuple[int, float]:
        """The beam that finds RECALL of the true matches of drawn queries, and the share it finds.

        Drawn are the first AUDIT nodes (nodes lie in hash order), and as many
        of those that have a match.
        """
        beam, n = BEAM, len(self.x)
        drawn = np.arange(min(n, AUDIT))
        while True:
            q, node = self.near(self.x[: min(n, 8 * AUDIT)], least, beam)
            with_match = np.unique(q[q != node])[:AUDIT]
            sample = np.union1d(drawn, with_match)
            r, c = np.nonzero(self.x[sample] @ self.x.T >= least)
            true = sample[r] != c
            want = int(true.sum())
            found = int(((q != node) & np.isin(q, sample)).sum())
            share = found / want if want else 1.0
            if share >= RECALL or 4 * beam >= n:
                return beam, share
            beam *= 2


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with the hashes of its vector (null if it cannot link), and the distinct vectors, scaled to length 1."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(good, F.lit(False)).alias("good"))
    plus = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 and 0.0 are equal
    rows = rows.withColumn("x", F.when(F.col("good"), plus))
    h = [F.when(F.col("good"), F.xxhash64(F.lit(s), "x")).alias(f"h{s}") for s in (1, 2)]
    rows = rows.select("vec_id", "x", *h)
    nodes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.any_value("x").alias("x"))
    # the largest component first, so that squares neither overflow nor vanish
    nodes = nodes.withColumn("top", F.array_max(F.transform("x", F.abs))).withColumn("x", F.transform("x", lambda v: v / F.col("top")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    nodes = nodes.withColumn("norm", norm).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "weight", "first", F.size("x").alias("dim"),
                                                  F.transform("x", lambda v: v / F.col("norm")).alias("x"))
    return rows.drop("x"), saved(nodes, "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_graphs(nodes: DataFrame, least: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, n, beam, recall, path): one graph file per shard and vector length."""
    spark = nodes.sparkSession
    shards = max(MIN_SHARDS, -(-nodes.count() // shard_rows))
    folder = scratch_path(spark, "graphs")

    def write(shard: int, dim: int, node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        graph = Graph.build(x)
        beam, recall = graph.audit(least - SLACK)
        data = io.BytesIO()
        np.savez(data, node=node, x=x, **{f"layer{i}": a for i, a in enumerate(graph.layers)})
        fs, root = shared_files(folder)
        fs.create_dir(root)
        path = f"{folder}/{own_name('graph')}.npz"
        with fs.open_output_stream(shared_files(path)[1]) as out:
            out.write(data.getvalue())
        row = ([shard], [dim], [len(x)], [beam], [recall], [path])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["shard", "dim", "n", "beam", "recall", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = np.stack((batch.column("shard").to_numpy(), batch.column("dim").to_numpy()))
            edges = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if at != (key := tuple(keys[:, a].tolist())):
                    if held:
                        yield write(*at, *map(np.concatenate, zip(*held, strict=True)))
                    at, held = key, []
                part = batch.slice(a, b - a)
                held.append((part.column("node").to_numpy(), _matrix(part.column("x"))))
        if held:
            yield write(*at, *map(np.concatenate, zip(*held, strict=True)))

    dealt = nodes.select(F.pmod("h1", F.lit(shards)).cast("long").alias("shard"), F.col("dim").cast("long").alias("dim"), "node", "x", "h2")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "h2").drop("h2")
    return cut(dealt.mapInArrow(run, "shard long, dim long, n long, beam long, recall double, path string"))


@lru_cache(maxsize=2)
def _load(path: str) -> tuple[np.ndarray, np.ndarray, Graph]:
    fs, name = shared_files(path)
    with fs.open_input_file(name) as f, np.load(io.BytesIO(f.read())) as z:
        x = z["x"]
        layers = [z[k] for k in sorted(z.files) if k.startswith("layer")]
        return z["node"], x, Graph(np.ascontiguousarray(x, np.float32), layers)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b)."""
    names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(names)))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    keep = []
    for i, (v, w) in enumerate(zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True)):
        v, w = root(v), root(w)
        if v != w:
            up[max(v, w)] = min(v, w)
            keep.append(i)
    return a[keep], b[keep]


def found_links(graphs: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(a, b): a spanning forest of the verified links that each (graph, slice of queries) finds."""
    slices = F.explode(F.expr(f"sequence(0L, n - 1, {SLICE}L)"))
    asks = graphs.select(F.col("dim"), F.col("path").alias("from"), slices.alias("at"))
    # a fixed number of parts: the rows are few and small, but each is much work
    parts = int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = graphs.join(asks, "dim").select("path", "beam", "from", "at").repartition(parts, "path", "from", "at").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                node, x, graph = _load(r["path"])
                mine, q, _ = _load(r["from"])
                span = slice(r["at"], r["at"] + SLICE)
                i, j = graph.near(np.ascontiguousarray(q[span], np.float32), least - SLACK, r["beam"])
                a, b = mine[span][i], node[j]
                ok = a != b
                # in double precision, in pieces
                for s in range(0, len(i), 1 << 16):
                    ok[s : s + (1 << 16)] &= np.einsum("ij,ij->i", q[span][i[s : s + (1 << 16)]], x[j[s : s + (1 << 16)]]) >= least
                a, b = forest(a[ok], b[ok])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return saved(work.mapInArrow(run, "a long, b long"), "links")


def count_links(members: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(node, links): the weight of all other nodes of the component with a cosine of at least ``least``.

    ``members``: node, root, weight, x, h2. Blocks of a component meet in pairs;
    of a large one, nodes near its mean are counted without being compared.
    """
    # what a large component's members need is sent to them under SALTS keys, so that no task takes all of them
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    members = cut(members.withColumn("salt", F.pmod("h2", F.lit(SALTS)).cast("int")))
    sizes = cut(members.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > MEMBERS))
    large = members.join(sizes.select("root", salted), ["root", "salt"])
    mean = large.select("root", F.posexplode("x").alias("i", "v")).groupBy("root", "i").agg(F.sum("v").alias("v"))
    mean = mean.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))
    mean = mean.select("root", F.transform("m", lambda s: s["v"]).alias("m"))
    mean = mean.withColumn("m", F.transform("m", lambda v: v / F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, b: a + b * b))))
    mean = mean.join(sizes, "root").select("root", "size", "m", salted)
    # half the threshold's angle, and a margin for rounding
    half = float(np.sqrt((1 + least) / 2)) + 1e-9
    dot = F.aggregate(F.zip_with("x", "m", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    marked = members.join(mean, ["root", "salt"], "left").withColumn("core", F.coalesce(dot >= half, F.lit(False))).drop("m")
    core = marked.filter("core").groupBy("root").agg(F.sum("weight").alias("sum")).select("root", "sum", salted)
    sure = marked.filter("core").join(core, ["root", "salt"]).select("node", (F.col("sum") - F.col("weight")).alias("links"))

    blocks = F.coalesce(F.ceil(F.col("size") / MEMBERS), F.lit(1)).cast("int")
    marked = marked.withColumn("blocks", blocks).withColumn("block", F.pmod("h2", blocks).cast("int"))
    every = F.expr("sequence(0, blocks - 1)")
    asks = marked.filter("not core").select("root", F.col("block").alias("q"), F.explode(every).alias("t"), F.lit(True).alias("ask"), "core", "node", "weight", "x")
    given = marked.select("root", F.explode(every).alias("q"), F.col("block").alias("t"), F.lit(False).alias("ask"), "core", "node", "weight", "x")
    work = asks.unionByName(given).repartition("root", "q", "t").sortWithinPartitions("root", "q", "t")

    def count(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(rows).combine_chunks()
        ask, own_core = (part.column(c).to_numpy() for c in ("ask", "core"))
        node, weight = (part.column(c).to_numpy() for c in ("node", "weight"))
        x = _matrix(part.column("x").chunk(0))
        q, t = np.flatnonzero(ask), np.flatnonzero(~ask)
        links = np.zeros(len(node), np.int64)
        for s in range(0, len(q), 256):
            some = q[s : s + 256]
            near = (x[some] @ x[t].T >= least) & (node[some][:, None] != node[t])
            links[some] = near @ weight[t]
            links[t] += np.where(own_core[t], weight[some] @ near, 0)
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit])], ["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("root", "q", "t")])
            edges = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if at != (key := tuple(keys[:, a].tolist())):
                    if held:
                        yield count(held)
                    at, held = key, []
                held.append(batch.slice(a, b - a))
        if held:
            yield count(held)

    met = work.mapInArrow(run, "node long, links long")
    return met.unionByName(sure).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    rows, nodes = nodes_of(vectors)
    graphs = build_graphs(nodes, least, shard_rows)
    roots = components(found_links(graphs, least))
    members = nodes.join(roots, "node").select("node", "root", "weight", "x", "h2")
    links = count_links(members, least)
    named = cut(nodes.select("node", "h1", "h2", "weight", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = named.groupBy("root").agg(F.min("first").alias("name"))
    facts = named.join(names, "root").join(links, "node", "left")
    facts = facts.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "name")
    out = rows.join(facts, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("name")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_vector_neighbours(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
