"""Jaccard join of word-n-gram sets with a prefix tree, and its components.

Two documents link when 100 * intersection >= percent * union of their sets.

1. Equal sets are one node, named by a 64-bit hash of the set (two different
   sets agree in it with a chance of 2^-64).
2. Candidates. Linked sets of at most N n-grams differ in at most
   D = N * 2 * (100 - percent) / (100 + percent) of them. If the hash space is
   cut into more than D regions, linked sets agree exactly in the regions that
   hold no difference. A set therefore publishes one hash per region; sets that
   share too few of them have no partner (see ``Plan``). Regions with fewer than
   two n-grams are left out where the others suffice, so common n-grams alone
   make no candidates. Numbers of regions depend on the size class; a set
   publishes for each class its partners may be in. A set and its partner share
   at least ``need`` of its k shared hashes, so the rarest one they share is
   among the k - need + 1 rarest of each; only these make groups.
   Each set also has counts of its n-grams in 2^CELL_BITS cells of the hash
   space; two sets differ in at least as many n-grams as their counts do. Those
   whose counts rule out every partner in a group leave it. A group of more than
   SEARCHED members is cut into blocks by size class and node, and two blocks
   meet in a task if their sizes allow a link.
3. The sets that published an equal hash go to the group of the smallest of
   them. A group's sets are stored in a prefix tree, their n-grams in one order,
   rarest in the group first. A probe walks the tree once: sets with the same
   beginning share its partial overlap, and a subtree is left when the n-grams
   missed so far or the remaining lengths rule out a link. Sets of one
   component need not be compared again, so a group returns a forest.
4. A group with more n-grams than GROUP_NGRAMS is dealt to several tasks, each
   with the group's smallest set. All pairs still unverified hold a set that is
   not connected to it. These sets are cut into blocks of about GROUP_NGRAMS and
   the connected ones into parts of as many; each block meets each part and each
   block in a task of its own, so no link is lost and no task has more than two
   of them.
5. Components of the forests, by contraction.

Sets and counts move once for each group and block they are in, which can be
more than the table has. Steps that move them are done in passes over the
groups, as many as keep a pass within the size of the table, and what a step
has written is deleted when the next ones no longer read it.

Cases: null text, or text without words, is an empty set and linked with
nothing; fewer than n words are one n-gram; repeated rows link as equal sets;
a row counts by its own text where an id is repeated; null ids are larger than
all others and their component is null unless it holds a proper id; ids are
below 2^62; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut, discard, saved, stored_bytes, table
from plurality.llm.components import components
from plurality.llm.words import hashed, mix, windows

WORDS, PERCENT = 3, 90
GROUP_NGRAMS = 2_000_000
NULL_IDS = 1 << 62
STRONG = 2
#: cells of the n-gram counts by which hopeless sets are found, and the members of a group that are compared with as many in one task
CELL_BITS, SEARCHED = 9, 10_000

#: parts at least in which the region hashes are matched and the groups compared, one after the other
PASSES = 4
#: what a pass may move in any case: rows with counts, and n-grams
PASS_ROWS, PASS_NGRAMS = 250_000, 64_000_000

SKETCH = "doc_id long, tie long, id long, s1 long, n long, counts binary, regions array<struct<kind:int,need:int,sigs:array<long>>>"
SETS = "leader long, part int, block int, probe boolean, node long, grams binary"
GOAL = ["leader", "part", "block", "probe"]


def ngram_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    for _, h, ends in hashed(texts, lower=True):
        grams, start = windows(h, words), 0
        for end in ends.tolist():
            n = end - start
            if n >= words:
                yield np.unique(grams[start : end - words + 1])
            else:
                yield windows(h[start:end], n, seed=n) if n else np.zeros(0, np.uint64)
            start = end


class Plan:
    """Size classes and their numbers of regions, for one threshold.

    Class c covers sizes from about RATIO^c on. Its ``regions`` exceed the most
    differences of a linked pair whose larger set is in the class, so the pair
    agrees in at least regions - differences of them. With ``weak`` regions of
    fewer than STRONG n-grams, at least regions - differences - weak agreeing
    ones are strong; if that is below 1, the weak ones are published as well.
    There are as many spare regions as it takes that this is rare: weak regions
    are expected to be two thirds of them at most.
    """

    RATIO = 1.5

    def __init__(self, percent: int):
        self.percent, self.spare = percent, 8
        while self.spare > 2 and self._weak(1 + 1 / self.spare) > 2 / 3 / self.spare:
            self.spare //= 2

    def _weak(self, regions: float) -> float:
        """Expected number of regions with fewer than two n-grams, both a difference."""
        mean = (100 + self.percent) / (2 * max(1, 100 - self.percent)) / regions
        return regions * (1 + mean) * float(np.exp(-mean))

    def largest(self, n: int) -> int:
        """Size of the largest set that can link to one of size n."""
        return n * 100 // self.percent

    def differences(self, n: int) -> int:
        return n * 2 * (100 - self.percent) // (100 + self.percent)

    @lru_cache(maxsize=4096)  # noqa: B019  (few sizes classes, lives as long as the plan)
    def bounds(self, kind: int) -> tuple[int, int]:
        return int(np.ceil(self.RATIO**kind)), int(np.ceil(self.RATIO ** (kind + 1))) - 1

    def kind(self, n: int) -> int:
        k = max(0, int(np.log(n) / np.log(self.RATIO)) - 1)
        while self.bounds(k)[1] < n:
            k += 1
        return k

    def regions(self, kind: int) -> int:
        d = self.differences(self.bounds(kind)[1])
        return d + 1 + (d + 1) // self.spare

    def published(self, grams: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(class, least number of shared hashes, hashes) for each class of a partner."""
        n, out = len(grams), []
        if not n or not self.differences(self.largest(n)):
            return out  # only equal sets link
        for kind in range(self.kind(n), self.kind(self.largest(n)) + 1):
            m = self.regions(kind)
            region = ((grams >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(region, minlength=m)
            total = np.zeros(m, np.uint64)
            np.add.at(total, region, mix(grams, 11))
            sig = mix(total + mix(np.arange(m, dtype=np.uint64) + np.uint64(kind << 40), 5), 3).view(np.int64)
            need = m - self.differences(min(self.largest(n), self.bounds(kind)[1])) - int((count < STRONG).sum())
            out.append((kind, max(1, need), sig[count >= STRONG] if need >= 1 else sig))
        return out


def sketch(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    plan = Plan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = pa.list_(pa.struct([("kind", pa.int32()), ("need", pa.int32()), ("sigs", pa.list_(pa.int64()))]))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
                out: list[list] = [[], [], []]
                regions, counts = [], []
                for doc_id, grams in zip(batch.column("doc_id").to_pylist(), ngram_sets(texts, words), strict=True):
                    s1 = int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)
                    row = (doc_id if doc_id is not None else NULL_IDS + (s1 & (NULL_IDS - 1)), s1, len(grams))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    cells = np.bincount((grams >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
                    counts.append(np.minimum(cells, 255).astype(np.uint8).tobytes())
                    regions.append([{"kind": kind, "need": need, "sigs": sigs} for kind, need, sigs in plan.published(grams)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *[pa.array(c, pa.int64()) for c in out], pa.array(counts, pa.binary()), pa.array(regions, region)],
                                                 ["doc_id", "tie", "id", "s1", "n", "counts", "regions"])

    return docs.mapInArrow(run, SKETCH)


def plausible(counts: np.ndarray, sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which sets have a partner that sizes and cell counts do not rule out; with ``side`` (booleans), a partner on the other side."""
    order = np.argsort(sizes, kind="stable")
    cells, n = counts[order].astype(np.int16), sizes[order].astype(np.int64)
    # sums of neighbouring cells differ by no more than the cells do, and rule out most pairs
    coarse = np.ascontiguousarray(cells.reshape(len(n), -1, 8).sum(axis=2, dtype=np.int16).T)
    hope = np.zeros(len(n), bool)
    here = np.arange(len(n)) if side is None else np.flatnonzero(~side[order])
    there = here if side is None else np.flatnonzero(side[order])
    other, lengths = np.ascontiguousarray(coarse[:, there]), n[there]
    for at, i in enumerate(here.tolist()):
        first = at + 1 if side is None else int(np.searchsorted(lengths * 100, n[i] * percent))
        stop = int(np.searchsorted(lengths, n[i] * 100 // percent, side="right"))
        if first >= stop or hope[i] and hope[there[first:stop]].all():
            continue
        most = (lengths[first:stop] + n[i]) * (100 - percent)
        apart = np.abs(other[:, first:stop] - coarse[:, i : i + 1]).sum(axis=0, dtype=np.int64)
        found = np.flatnonzero(apart * (100 + percent) <= most)
        if hope[i]:
            found = found[~hope[there[first + found]]]
        apart = np.abs(cells[there[first + found]] - cells[i]).sum(axis=1, dtype=np.int64)
        near = there[first + found[apart * (100 + percent) <= most[found]]]
        if len(near):
            hope[i] = hope[near] = True
    out = np.zeros(len(n), bool)
    out[order] = hope
    return out


def _dealt(members: DataFrame, percent: int, searched: int) -> DataFrame:
    """Rows (node, n, leader) of large groups with ``pairs``, the pairs of blocks (``lo``, ``hi``) they are in; ``side`` is true for those of hi <> lo.

    Linked sets are in the same or in neighbouring size classes; a class has as
    many blocks as it takes for about ``searched`` members each.
    """
    # a little more than the largest quotient of linked sizes, so that rounding does not matter
    members = members.withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.001 * 100 / percent))).cast("long"))
    sizes = cut(members.groupBy("leader", "class").agg(F.ceil(F.count("*") / searched).cast("long").alias("own")))
    for name, step in (("up", 1), ("down", -1)):
        near = sizes.select("leader", (F.col("class") - step).alias("class"), F.col("own").alias(name))
        sizes = cut(sizes.join(near, ["leader", "class"], "left").fillna(0, [name]))
    rows = members.join(sizes, ["leader", "class"]).withColumn("a", F.expr("pmod(xxhash64(node), own)"))
    # a block is named by class and number
    named = "(({}) * 1073741824L + ({}))".format
    pairs = """concat(
        transform(sequence(0L, own - 1), x -> struct({0} AS lo, {1} AS hi, a > x AS side)),
        transform(filter(sequence(0L, greatest(up, 1L) - 1), x -> up > 0), x -> struct({2} AS lo, {3} AS hi, false AS side)),
        transform(filter(sequence(0L, greatest(down, 1L) - 1), x -> down > 0), x -> struct({4} AS lo, {2} AS hi, true AS side)))"""
    pairs = pairs.format(named("class", "least(a, x)"), named("class", "greatest(a, x)"), named("class", "a"), named("class + 1", "x"), named("class - 1", "x"))
    return rows.select("node", "n", "leader", F.expr(pairs).alias("pairs"))


def _hopeful(wanted: DataFrame, percent: int) -> DataFrame:
    """Rows (node, n, leader) whose set has a plausible partner in its (leader, lo, hi) group; only between its sides if it has two."""
    groups = wanted.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            side = table.column("side").to_numpy() if table.column("lo")[0] != table.column("hi")[0] else None
            yield from table.select(["node", "n", "leader"]).filter(pa.array(plausible(cells, table.column("n").to_numpy(), percent, side))).to_batches()

        held: list[pa.RecordBatch] = []  # of the group that is not complete yet
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("leader", "lo", "hi")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and held and [held[0].column(c)[0].as_py() for c in ("leader", "lo", "hi")] != keys[:, a].tolist():
                    yield from chosen(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from chosen(pa.Table.from_batches(held))

    return groups.mapInArrow(run, "node long, n long, leader long")


class Tree:
    """Prefix tree of ascending integer sequences, with compressed paths."""

    __slots__ = ("part", "next", "members", "least", "most")

    def __init__(self, part: np.ndarray):
        self.part, self.next, self.members = part, {}, []
        self.least, self.most = 1 << 60, 0

    def add(self, seq: np.ndarray, member: int) -> None:
        node, at, size = self, 0, len(seq)
        node.least, node.most = min(node.least, size), max(node.most, size)
        while at < size:
            child = node.next.get(int(seq[at]))
            if child is None:
                child = node.next[int(seq[at])] = Tree(seq[at:])
                child.least = child.most = size
                child.members.append(member)
                return
            k = min(len(child.part), size - at)
            differ = np.flatnonzero(child.part[:k] != seq[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.part):
                upper = Tree(child.part[:k])
                upper.least, upper.most = child.least, child.most
                child.part = child.part[k:]
                upper.next[int(child.part[0])] = child
                node.next[int(seq[at])] = child = upper
            child.least, child.most = min(child.least, size), max(child.most, size)
            node, at = child, at + k
        node.members.append(member)

    def links(self, seq: np.ndarray, sizes: np.ndarray, member: np.ndarray, percent: int) -> Iterator[int]:
        """Members that link to ``seq``; ``member`` is a scratch mask over all integers, true for those of seq."""
        n = len(seq)
        stack = [(x, 0, 0) for x in self.next.values()]
        while stack:
            node, depth, shared = stack.pop()
            if 100 * node.most < percent * n or 100 * n < percent * node.least:
                continue
            depth += len(node.part)
            shared += int(np.count_nonzero(member[node.part]))
            # what of seq lies beyond this path's last integer can still be shared
            ahead = n - int(np.searchsorted(seq, node.part[-1], side="right"))
            if 100 * (shared + min(ahead, node.most - depth)) < percent * max(n, node.least):
                continue
            for x in node.members:
                if 100 * shared >= percent * (n + int(sizes[x]) - shared):
                    yield x
            stack.extend((x, depth, shared) for x in node.next.values())


def forest(sets: list[np.ndarray], percent: int, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (positions in ``sets``) that connect what is connected; the first set should be the likeliest centre.

    With ``probes`` only pairs of one of these and another set are looked for.
    """
    sizes = np.array([len(s) for s in sets])
    token, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(token), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(token))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ranked = rank[flat]
    # sets with too many n-grams that nobody else has cannot link; dropping them can make others' n-grams unique
    alive, fits = np.ones(len(sets), bool), count
    owner = np.repeat(np.arange(len(sets)), sizes)
    while True:
        lonely = np.bincount(owner, fits[flat] == 1, minlength=len(sets))
        dead = alive & (100 * (sizes - lonely) < percent * sizes)
        if not dead.any():
            break
        alive &= ~dead
        fits = np.bincount(flat[alive[owner]], minlength=len(token))
    if alive.sum() < 2:
        return []
    ordered = {int(i): np.sort(ranked[starts[i] : starts[i + 1]]) for i in np.flatnonzero(alive)}
    tree, probing = Tree(np.zeros(0, np.int64)), frozenset(probes or ())
    for i, seq in ordered.items():
        if i not in probing:
            tree.add(seq, i)
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, mask = [], np.zeros(len(token), bool)
    for i in ordered if probes is None else [p for p in probes if p in ordered]:
        # pairs inside the first set's component need no proof
        if probes is None and i and find(i) == find(0):
            continue
        mask[ordered[i]] = True
        for j in tree.links(ordered[i], sizes, mask, percent):
            if (a := find(i)) != (b := find(j)):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        mask[ordered[i]] = False
    return out


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between nodes found in each (leader, part, block) group of SETS rows."""
    groups = sets.repartition("leader", "part", "block").sortWithinPartitions("leader", "part", "block", F.desc("probe"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(nodes: list[int], grams: list[np.ndarray], probing: int) -> pa.RecordBatch:
            pairs = forest(grams, percent, list(range(probing)) if probing else None) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        key, nodes, grams, probing = None, [], [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("leader", "part", "block", "probe", "node", "grams")]
            for leader, part, block, probe, node, data in zip(*columns, strict=True):
                here = (leader.as_py(), part.as_py(), block.as_py())
                if here != key:
                    if nodes:
                        yield solve(nodes, grams, probing)
                    key, nodes, grams, probing = here, [], [], 0
                if nodes and nodes[-1] == node.as_py():
                    continue  # a repeated row
                nodes.append(node.as_py())
                grams.append(np.frombuffer(data.as_py(), np.uint64))
                probing += probe.as_py()
        if nodes:
            yield solve(nodes, grams, probing)

    return groups.mapInArrow(run, "a long, b long")


def _passes(volume: int, most: int) -> int:
    """In how many passes ``volume`` moves if each may take ``most``."""
    return max(1, -(-volume // most))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _candidates(sketched: DataFrame) -> DataFrame:
    """Distinct (node, leader): the sets that published an equal hash, with the smallest of them. Deletes ``sketched``."""
    # equal sets publish the same hashes under the same node, so copies are no partners
    hits = sketched.select(F.col("s1").alias("node"), F.explode("regions").alias("r"))
    hits = hits.select("node", "r.kind", "r.need", F.explode("r.sigs").alias("sig"))
    known, met = stored_bytes(sketched), []
    for i in range(PASSES):
        mine = hits.filter(F.pmod("sig", F.lit(PASSES)) == i)
        shared = mine.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("rows"))
        shared = saved(shared.filter("a < b").select("sig", "rows"), "shared")
        # distinct where a hash's rows are: copies do not travel to their node
        joined = mine.join(shared, "sig").distinct().select("node", "kind", "need", F.struct("rows", "sig").alias("hit"))
        met.append(saved(joined.repartition("node").groupBy("node", "kind", "need").agg(F.collect_list("hit").alias("hits")), "hits"))
        discard(shared)
    discard(sketched)  # all regions that two sets share are in the hits
    # a set's rarest hits, one of which it shares with each partner
    every, rarest = _union(met), []
    passes = _passes(PASSES * sum(map(stored_bytes, met)), max(known, 1))
    for i in range(passes):
        mine = every.filter(F.pmod(F.xxhash64("node"), F.lit(passes)) == i)
        mine = mine.groupBy("node", "kind", "need").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
        mine = mine.filter(F.size("hits") >= F.col("need")).withColumn("hits", F.expr("slice(hits, 1, size(hits) - need + 1)"))
        rarest.append(saved(mine.select("node", F.col("hits.sig").alias("sigs")), "rarest"))
    for old in met:
        discard(old)
    every, met = _union(rarest).select("node", F.explode("sigs").alias("sig")), []
    passes = _passes(PASSES * sum(map(stored_bytes, rarest)), max(known, 1))
    for i in range(passes):
        mine = every.filter(F.pmod("sig", F.lit(passes)) == i)
        shared = saved(mine.groupBy("sig").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").drop("last"), "shared")
        met.append(saved(mine.join(shared, "sig").select("node", "leader").distinct(), "pairs"))
        discard(shared)
    for old in rarest:
        discard(old)
    out = saved(_union(met).distinct(), "candidates")
    for old in met:
        discard(old)
    return out


def _thinned(candidates: DataFrame, narrow: DataFrame, percent: int, n_rows: int) -> DataFrame:
    """Saved rows (node, n, leader) of the candidates whose counts do not rule out every partner in the group."""
    wanted = saved(candidates.join(narrow.select("node", "n").distinct(), "node"), "members")
    large = cut(wanted.groupBy("leader").count().filter(F.col("count") > SEARCHED).select("leader"))
    alone = F.expr("array(struct(0L AS lo, 0L AS hi, false AS side))").alias("pairs")
    groups = wanted.join(large, "leader", "left_anti").select("node", "n", "leader", alone)
    if not large.isEmpty():
        groups = groups.unionByName(_dealt(wanted.join(large, "leader", "left_semi").select("node", "n", "leader"), percent, SEARCHED))
    groups = saved(groups, "groups")
    counts = saved(narrow.select("node", "counts").join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "counts")
    passes = _passes(groups.agg(F.sum(F.size("pairs"))).first()[0] or 0, max(PASS_ROWS, n_rows))
    found = []
    for i in range(passes):
        mine = groups.withColumn("pairs", F.expr(f"filter(pairs, p -> pmod(xxhash64(leader, p.lo, p.hi), {passes}) = {i})")) if passes > 1 else groups
        mine = mine.filter(F.size("pairs") > 0).join(counts, "node").select("node", "n", "leader", "counts", F.explode("pairs").alias("p"))
        found.append(saved(_hopeful(mine.select("node", "n", "leader", "p.lo", "p.hi", "p.side", "counts"), percent), "hopeful"))
    out = saved(_union(found).distinct(), "wanted")
    for old in (wanted, groups, counts, *found):
        discard(old)
    return out


def _compared(texts: DataFrame, words: int, percent: int, passes: int) -> DataFrame:
    """Edges between the sets of ``texts`` (node, text, and in ``goals`` the groups it is in, with its n-grams made anew for each pass)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
            for node, goals, grams in zip(batch.column("node"), batch.column("goals"), ngram_sets(texts, words), strict=True):
                goals, data = goals.values, pa.scalar(grams.tobytes(), pa.binary())
                for at in range(0, len(goals), 64):
                    to = goals.slice(at, 64)
                    rows = [to.field(c) for c in GOAL] + [pa.array([node.as_py()] * len(to), pa.int64()), pa.array([data] * len(to), pa.binary())]
                    yield pa.RecordBatch.from_arrays(rows, [*GOAL, "node", "grams"])

    found = []
    for i in range(passes):  # some of the groups, then the next ones
        mine = F.expr(f"filter(goals, g -> pmod(xxhash64(g.leader, g.part, g.block), {passes}) = {i})")
        some = texts.select("node", mine.alias("goals"), "text").filter(F.size("goals") > 0)
        found.append(saved(_links(some.mapInArrow(spread, SETS), percent), "edges"))
    return _union(found)


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group_ngrams: int = GROUP_NGRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id per row, and ``row``, ``tie`` (by which rows are told apart) and ``first`` (it stands for its component)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    row_key = [F.coalesce("doc_id", F.lit(NULL_IDS)).alias("row"), "tie"]
    sketched = saved(sketch(rows, words, percent), "sketch")
    narrow = saved(sketched.select("doc_id", *row_key, "id", "n", F.col("s1").alias("node"), "counts"), "narrow")
    known = narrow.drop("counts")
    n_rows, n_grams = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(PASS_NGRAMS, n_grams // PASSES)
    candidates = _candidates(sketched)
    wanted = _thinned(candidates, narrow, percent, n_rows)
    discard(candidates)
    # parts of a group by its number of n-grams; most have one
    parts = wanted.groupBy("leader").agg(F.ceil(F.sum("n") / group_ngrams).cast("int").alias("parts"))
    big = cut(parts.filter("parts > 1"))
    # the leader is in every part of its group
    own = F.expr("if(node = leader, sequence(0, coalesce(parts, 1) - 1), array(cast(pmod(xxhash64(node), coalesce(parts, 1)) as int)))")
    placed = wanted.join(big, "leader", "left").select("node", "n", "leader", F.explode(own).alias("part"))
    placed = placed.select("node", "n", "leader", "part", F.lit(0).alias("block"), F.lit(False).alias("probe"))

    def goals(places: DataFrame) -> DataFrame:
        return places.groupBy("node").agg(F.collect_set(F.struct(*GOAL)).alias("goals"))

    # one row of each node gives its text; rows are told apart by id and text hash
    owners = known.select("row", "tie", "node").join(wanted.select("node").distinct(), "node", "left_semi")
    owners = owners.groupBy("node").agg(F.min(F.struct("row", "tie")).alias("own")).select("own.row", "own.tie", "node")
    # the texts that are compared are written before their sets move, so that both shuffles are not there at once
    texts = rows.select(*row_key, "text").join(owners.join(goals(placed), "node"), ["row", "tie"])
    texts = saved(texts.select("node", "goals", "text"), "texts")
    volume = placed.agg(F.sum("n")).first()[0] or 0
    edges = _compared(texts, words, percent, max(PASSES, _passes(volume, most)))
    if not big.isEmpty():
        # sets of a large group outside its leader's component meet the others and each other, in blocks
        member = components(edges)
        root = member.join(big, member["node"] == big["leader"], "left_semi").select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
        large = wanted.join(big, "leader").select("leader", "node", "n").join(member, "node", "left").join(root, "leader", "left")
        large = cut(large.select("leader", "node", "n", (F.coalesce("root", "node") != F.coalesce("leader_root", "leader")).alias("apart")))
        blocks = large.groupBy("leader").agg(*[F.ceil(F.coalesce(F.sum(F.when(F.col("apart") == x, F.col("n"))), F.lit(0)) / group_ngrams).cast("int").alias(name)
                                               for x, name in ((True, "blocks"), (False, "parts"))]).filter("blocks > 0")
        dealt = large.join(cut(blocks), "leader").select("leader", "node", "n", "apart", "blocks", "parts")
        dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(node), if(apart, blocks, parts)) as int)"))
        meets = F.expr("""if(apart, concat(
            transform(sequence(0, blocks - 1), x -> struct(-1 - least(own, x) AS part, greatest(own, x) AS block, own > x AS probe)),
            transform(filter(sequence(0, greatest(parts, 1) - 1), x -> parts > 0), x -> struct(x AS part, own AS block, true AS probe))),
            transform(sequence(0, blocks - 1), x -> struct(own AS part, x AS block, false AS probe)))""")
        pairs = dealt.select("leader", "node", "n", F.explode(meets).alias("m")).select("leader", "node", "n", "m.part", "m.block", "m.probe")
        volume = pairs.agg(F.sum("n")).first()[0] or 0
        # the sets of these groups are made again from their texts
        again = saved(texts.drop("goals").join(goals(pairs), "node"), "texts")
        edges = edges.unionByName(_compared(again, words, percent, _passes(volume, most)))
        discard(again)
    discard(texts)
    discard(wanted)
    member = components(edges)
    # the smallest id of each set, and of each component; sets without links are their own
    least = known.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    joined = cut(member.join(least, "node"))
    smallest = cut(joined.groupBy("root").agg(F.min("least").alias("component")))
    linked = joined.join(smallest, "root").select("node", "component")
    named = cut(least.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component")))
    out = known.join(named, "node", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    out = saved(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") < NULL_IDS, F.col("component")).alias("component_id"),
                           "row", "tie", (F.col("component") == F.col("id")).alias("first")), "components")
    discard(narrow)
    return out


def keep_first(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One document of each component, the one of the smallest id, with its own columns whatever their names. Repeated rows leave one."""
    kept = join_components(docs, words, percent).filter("first").select("row", "tie").distinct()
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NULL_IDS)).alias("row"), F.xxhash64("doc.text").alias("tie"))
    return rows.join(kept, ["row", "tie"], "left_semi").dropDuplicates(["row", "tie"]).select("doc.*")


def op6_jaccard_join(spark, sf_dir):
    out = join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")
