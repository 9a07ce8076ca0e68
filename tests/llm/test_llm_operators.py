"""Each operator against brute force, on test tables and on awkward rows.

ODD holds nulls, empty and blank texts, a very long text, repeated rows, equal
texts under different ids, a null id, and columns named like the results'.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurality.llm import (chunk_bpe, fingerprints, jaccard_join, license_scan, packing, quality_model, quality_rules, substring_dedup,
                           token_files, tokens, warc)
from plurality.llm.common import ordered
from plurality.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")
SPACE = "[^\x20\x09-\x0D]+"
_rng = random.Random(1)
VOCABULARY = ["".join(_rng.choice("abcdefghij") for _ in range(_rng.randint(1, 7))) for _ in range(900)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + (r.choice(".\n,") if r.random() < 0.1 else "") for _ in range(n))


PASSAGE = prose(99, 70)
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (5, "Two WORDS"), (6, "two words"), (7, prose(7, 30_000)),
    (8, prose(8, 300)), (9, prose(8, 300)), (9, prose(8, 300)), (10, prose(10, 80) + " " + PASSAGE + " " + prose(11, 40)),
    (11, prose(12, 20) + "\n" + PASSAGE), (12, "été naïf 中文 🙂 <|endoftext|> á \x1c x  y\t\tz\n\n\nÀÉ"), (13, "x" * 5000),
    (14, " ".join(["same line here\n"] * 40)), (15, "Released under the MIT License. licensed under the Apache License, Version 2.0"),
    (None, "a text without an id " + PASSAGE), (None, None), (16, prose(8, 300).replace("a", "b", 1)), (-3, PASSAGE),
]


def odd(spark, rows=None):
    rows = ODD if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("n_words", "kept", "score", "row", "tie", "id", "component_id", "anchors", "length", "offset", "sequence_id", "labels"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def both(spark):
    """The awkward rows and a test table, as (DataFrame, rows)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return [(odd(spark), ODD), (docs, [(r.doc_id, r.text) for r in docs.collect()])]


def key(rows):
    return Counter(map(tuple, rows))


def test_ordered_gives_ranks_and_sums(spark):
    df = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)], "k long, v long")
    got = {r.k: (r._rank, r._before) for r in ordered(df, ["k"], "v").collect()}
    values = dict((i * 7 % 50, i % 3) for i in range(50))
    assert got == {k: (k, sum(values[j] for j in range(k))) for k in range(50)}


# -- 1 fingerprints


def elements(text):
    found = re.findall(r"[^\n]{1,120}[^\n.!?]{0,80}[.!?]*\n*|\n+", text)
    return set(Counter(found).items())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rows = [(i, t) for i, t in ODD if i is not None] + [(None, "only one without an id")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df, rows in [(odd(spark, rows), rows), (docs, [tuple(r) for r in docs.collect()])]:
        line = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
        want = []
        for k, (i, t) in enumerate(line):
            x, n = line[(k + 1) % len(line)][1], len(t)
            e = t[: n - n // 2] + x[: n // 2]
            want.append((i, n, hashlib.sha256(e.encode()).hexdigest(), round(jaccard(elements(t), elements(e)), 9), round(jaccard(elements(t), elements(x)), 9)))
        got = fingerprints.compare_versions(df).collect()
        assert key((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == key(want)
    prints = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint for r in got)
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.compare_versions(odd(spark, [])).count() == 0
    alone = fingerprints.compare_versions(odd(spark, [(4, "abcd")])).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_sketches_retry_and_peel(spark):
    """Groups far beyond the smallest size still give exact differences."""
    many = spark.createDataFrame([(list(range(0, 4 * 60, 4)), list(range(40, 4 * 75, 4)))], "a array<long>, b array<long>")
    sql = f"transform(array(concat(transform(a, e -> (xxhash64(e) & -4L)), transform(b, e -> (xxhash64(e) & -4L) | 1L))), g -> {fingerprints._difference('g', 1)})[0]"
    assert many.select(F.expr(sql).alias("d")).first().d == len(set(range(0, 240, 4)) ^ set(range(40, 300, 4)))
    small = fingerprints._peeled("transform(a, e -> xxhash64(e) & -4L)", "transform(b, e -> xxhash64(e) & -4L)", 8)
    assert many.select(F.expr(small).alias("d")).first().d is None


@pytest.mark.parametrize("width", [4, 32])
def test_stored_fingerprints_give_back_the_differing_paragraphs(spark, width):
    """Two fingerprints alone: the recovered digests are those of the paragraphs that differ, or all is null."""
    r, rows = random.Random(width), []
    for i in range(60):
        lines = [prose(500 + 100 * i + k, 8) for k in range(r.randint(0, 60))]
        other = list(lines)
        for _ in range(r.choice([0, 1, 2, 5, 15, 60])):
            if other and r.random() < 0.6:
                other[r.randrange(len(other))] = prose(r.randrange(10**6), 8)
            else:
                other.insert(r.randint(0, len(other)), prose(r.randrange(10**6), 8))
        rows.append((i, "\n".join(lines), "\n".join(other)))
    df = fingerprints.with_sketches(spark.createDataFrame(rows, "i int, a string, b string"), ["a", "b"], width).cache()
    found = fingerprints.compare_fingerprints(df, "_f_a", "_f_b", width).collect()
    good = 0
    for x in found:
        a, b = set(x["_e_a"]), set(x["_e_b"])
        if x.likeness is None:
            assert x.only_left is None and x.only_right is None and len(a ^ b) > width
            continue
        good += len(a ^ b) > 0
        assert x.only_left == sorted(a - b) and x.only_right == sorted(b - a)
        assert x.likeness == (len(a & b) / len(a | b) if a | b else 1.0)
    assert good > 15


# -- 2 chunk BPE, tokens


def library(path):
    return tokens.UnitEncoder(path).lib


def test_unit_encoder_equals_the_library():
    pieces = ["a", "B", "é", "É", "'s", "'T", " ", "  ", "\n", "\n\n", "\t", "1", "23", ".", ",!", "<|endoftext|>", "́", "\xa0", "\x1c", "\x85", "中", "🙂",
              "İ", "ß", "ª", "½", "_", "|", " ", "　", "\x00"]
    r = random.Random(3)
    for path in (WORD, BYTE):
        codec = tokens.UnitEncoder(path, cache_units=50)
        for text in ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(4000)] + [t or "" for _, t in ODD if t is None or len(t) < 6000]:
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == codec.library(text), text


def test_chunks_are_repaired_whatever_the_cuts():
    codec, r = tokens.UnitEncoder(WORD), random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", " of", "\n", " ", "  ", "x" * 300, "中", "<|endoftext|>", "foo bar baz ", "!"]) for _ in range(r.randint(0, 400)))
        assert b"".join(chunk_bpe.chunks(text.encode())).decode() == text
        cuts = sorted({r.randrange(len(text) + 1) for _ in range(9)} | {0, len(text)})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        assert chunk_bpe.assemble(codec, parts, [codec.encode(p) for p in parts]) == codec.encode(text)


def test_chunks_of_shared_passages_are_equal():
    body = prose(5, 3000).encode()
    shared = set(chunk_bpe.chunks(b"some other beginning " + body)) & set(chunk_bpe.chunks(body))
    assert sum(map(len, shared)) > 0.9 * len(body)


def test_chunk_bpe(spark):
    lib = library(WORD)
    for df, rows in both(spark):
        want = []
        for i, t in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert key(chunk_bpe.digests(df, WORD).collect()) == key(want)
    real = chunk_bpe.encode_documents(odd(spark, ODD[:6]), WORD).collect()
    assert {r.doc_id: r.decoded for r in real}[4] == lib.decode(lib.encode("two words").ids)
    assert chunk_bpe.digests(odd(spark, []), WORD).count() == 0


# -- 3 quality rules


def metrics(text):
    text = text or ""
    words = re.findall(SPACE, text)
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(spans)
    covered = {j for i, s in enumerate(spans) if count[s] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_metrics(spark):
    labels = spark.createDataFrame([(8, 1), (8, None), (None, 1), (3, 0)], "doc_id long, quality int")
    for df, rows in both(spark):
        got = quality_rules.judge(df, labels).collect()
        want = key((i, *metrics(t)) for i, t in rows)
        assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
            assert r.base_failed == failed and r.kept == (not failed)  # too few labels to prove a cutoff
    assert quality_rules.judge(odd(spark, []), labels).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(1, 0), (30, 2), (200, 0), (1000, 3), (5000, 4), (5000, 9), (3000, 100), (20, 20), (40_000, 55)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.002).alias("p"))
    for r in df.collect():
        a = Fraction(2, 1000)
        exact = 1.0 if r.k >= 0.002 * r.n else float(sum(math.comb(r.n, i) * a**i * (1 - a) ** (r.n - i) for i in range(r.k + 1)))
        assert r.p == pytest.approx(exact, rel=1e-8)


def test_cutoffs_follow_the_bound(spark):
    """The strictest proven cutoff is taken per stratum; a stratum with few labels has none."""
    rows = [("en", 100, 0)] * 8000 + [("en", 100, 9)] * 3 + [("en", 100, 50)] * 30 + [("de", 100, 0)] * 50 + [(None, 100, 0)] * 6000
    df = spark.createDataFrame(rows, "lang string, word_chars long, n_symbols long")
    good = df.select("lang", F.struct("word_chars", "n_symbols", F.lit(0).cast("long").alias("n_capitals"), F.lit(0).cast("long").alias("n_dup_lines"),
                                      F.lit(1).cast("long").alias("n_lines")).alias("_m"))
    got = {r._stratum: r.cut_symbols for r in quality_rules.choose_cutoffs(good, "lang", alpha=0.01).collect()}
    assert got["de"] is None and got[None] == 0.02 and got["en"] == 0.02
    got = {r._stratum: r.cut_symbols for r in quality_rules.choose_cutoffs(good, "lang", alpha=0.002).collect()}
    assert got["en"] is None  # 30 of 8033 are above every cutoff


# -- 4 classifier


def test_factorisation_machine_identity():
    r = np.random.default_rng(0)
    m = quality_model.Machine(r.normal(size=quality_model.N_FEATURES + 1), r.normal(size=(quality_model.N_FEATURES, 4)))
    x, v = np.array([3, 9, 40]), np.array([0.5, -1.0, 2.0])
    direct = m.w[-1] + m.w[x] @ v + sum(m.v[x[i]] @ m.v[x[j]] * v[i] * v[j] for i in range(3) for j in range(i + 1, 3))
    assert m.logits(x, v, np.array([3]))[0] == pytest.approx(direct)


def test_quality_model_holds_out_and_predicts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert sum(p == q for p, q in tested) / len(tested) >= 0.95
    # labels of held-out rows do not matter
    flipped = labels.withColumn("quality", F.when(quality_model.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.classify(docs, flipped).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got})


def test_quality_model_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.classify(odd(spark), none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.classify(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert quality_model.classify(odd(spark, []), labels).count() == 0
    kept = quality_model.keep_documents(odd(spark), labels)
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.predicted for r in got)


# -- 5 WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to string, size string")


def test_warc(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a/ b\r\nX: y", big), (2, None, big), (9, "u", big), (9, "u", big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""),
            (None, "u", big), (8, "u", "<html>" * 200_000), (1, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    got = warc.read_archives(warc.write_archives(pages(spark, [(*r, "x", "y", "z") for r in rows]), scratch_path(spark, "w"), archive_bytes=300)).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == big and i not in (2, None)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert key(got) == key(want)
    assert warc.read_archives(warc.write_archives(pages(spark, []), scratch_path(spark, "w"))).count() == 0


def test_warc_table(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    first, want = {}, []
    for r in sorted(table.collect(), key=lambda r: r.page_id):
        data = (r.html or "").encode()
        lead = first.setdefault(data, r.page_id) if len(data) >= 100 else r.page_id
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if lead == r.page_id else "revisit", None if lead == r.page_id else lead))
    assert key(warc.op5_warc(spark, SF).collect()) == key(want)


def test_warc_damage_is_found():
    import io

    html = b"<html>" + bytes(range(32, 127)) * 5
    good = [warc.record(i, "u", html, hashlib.sha256(html).hexdigest(), None, False) for i in range(3)]
    data = b"".join(map(warc.member, good))
    assert [p for *_, p in warc.read_records(io.BytesIO(data))] == [html] * 3
    bad = [good[1].replace(b"abc", b"abd"), good[1].replace(b"Content-Length: ", b"Content-Length: 9", 1), good[1][:-4]]
    for record in bad:
        with pytest.raises((ValueError, KeyError)):
            list(warc.read_records(io.BytesIO(warc.member(good[0]) + warc.member(record))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-30])))


# -- 6 Jaccard join


def shingles(text, k):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def joined(rows, k, percent):
    """(id, size, component) by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(sets[n]), least.get(find(n))) for n, (i, _) in enumerate(rows)]


def near_rows():
    """Families of near copies around both thresholds, chains and repeats."""
    r, rows = random.Random(6), list(ODD)
    for family in range(25):
        words = prose(1000 + family, r.choice([6, 9, 12, 25, 60, 150, 400])).split()
        for _ in range(r.randint(2, 9)):
            if r.random() < 0.7:
                words = list(words)
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            if r.random() < 0.3:
                words = copy
            rows.append((100 + len(rows) if r.random() < 0.95 else None, " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "group"), [(3, 90, 2_000_000), (5, 80, 300)])
def test_jaccard_join(spark, k, percent, group):
    rows = near_rows()
    got = jaccard_join.join_components(odd(spark, rows), k, percent, group).collect()
    want = joined(rows, k, percent)
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(want)
    assert len({c for *_, c in want}) < len(rows) - 60
    kept = jaccard_join.keep_first(odd(spark, rows), k, percent).collect()
    assert {r.doc_id for r in kept if r.text} >= {c for *_, c in want if c is not None and c in {i for i, t in rows if shingles(t, k)}}


def copies(seed, n, words, changed):
    """Copies of one text, each with its own ``changed`` words replaced."""
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for i in r.sample(range(words), changed):
            copy[i] = f"new{r.random()}"
        out.append(" ".join(copy))
    return out


def spied(monkeypatch, rows_per_task):
    """Appends (sets, n-grams of the largest task) of each step that compares sets."""
    links = jaccard_join._links

    def spy(sets, percent):
        keys = [c for c in ("leader", "part", "block") if c in sets.columns]
        tasks = sets.dropDuplicates([*keys, "node"]).groupBy(*keys).agg(F.sum(F.length("grams") / 8).alias("n")).collect()
        rows_per_task.append((sets.select("node").distinct().count(), max((x.n for x in tasks), default=0)))
        return links(sets, percent)

    monkeypatch.setattr(jaccard_join, "_links", spy)


def test_large_groups_are_compared_in_bounded_blocks(spark, monkeypatch):
    """Long texts that agree in regions, that their counts cannot tell apart and that don't link, but for a few."""
    texts = copies(21, 60, 6000, 80)
    texts += [x.replace(x.split()[5], "other", 1) for x in texts[:8]]
    rows, steps = list(enumerate(texts)), []
    spied(monkeypatch, steps)
    got = jaccard_join.join_components(odd(spark, rows), 3, 90, 60_000).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(joined(rows, 3, 90))
    assert len({r.component_id for r in got}) == 60
    # two blocks of 60,000, and what the hash deals unevenly
    assert len(steps) == jaccard_join.PASSES + 1 and max(n for _, n in steps) <= 2 * 2 * 60_000 < 60 * 5900


def test_groups_above_searched_are_thinned_by_counts(spark, monkeypatch):
    """Different texts with one passage share regions; only the linked ones' sets may move."""
    passage = prose(31, 130)
    texts = [prose(3000 + i, 35) + " " + passage + " " + prose(4000 + i, 35) for i in range(150)]
    texts += [x.replace(x.split()[5], "other", 1) for x in texts[:8]] + copies(32, 40, 60, 1) + [prose(i, 15 + i) for i in range(5000, 5040)]
    rows, steps = list(enumerate(texts)), []
    monkeypatch.setattr(jaccard_join, "SEARCHED", 10)
    spied(monkeypatch, steps)
    got = jaccard_join.join_components(odd(spark, rows), 5, 80).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(joined(rows, 5, 80))
    linked = sum(v for v in Counter(r.component_id for r in got).values() if v > 1)
    assert 16 <= linked and steps[0][0] <= linked + 5


def test_counts_of_groups_move_in_passes(spark, monkeypatch):
    """A large group's counts go to each of its pairs of blocks; no pass may move more of them than the table has rows."""
    passage = prose(41, 130)
    texts = [prose(6000 + i, 35) + " " + passage + " " + prose(7000 + i, 35) for i in range(120)]
    texts += [x.replace(x.split()[5], "other", 1) for x in texts[:6]]
    rows, moved, hopeful = list(enumerate(texts)), [], jaccard_join._hopeful

    def spy(wanted, percent):
        moved.append(wanted.count())
        return hopeful(wanted, percent)

    monkeypatch.setattr(jaccard_join, "SEARCHED", 10)
    monkeypatch.setattr(jaccard_join, "PASS_ROWS", 1, raising=False)
    monkeypatch.setattr(jaccard_join, "_hopeful", spy)
    before = scratch_tables(spark)
    got = jaccard_join.join_components(odd(spark, rows), 5, 80).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(joined(rows, 5, 80))
    # twice the table for what the hash deals unevenly
    assert sum(moved) > 4 * len(rows) and max(moved) <= 2 * len(rows)
    # what the steps have written is gone, but for what the result reads
    assert {re.sub("-[0-9a-f]+$", "", x) for x in scratch_tables(spark) - before} <= {"components", "edges"}


def scratch_tables(spark):
    """Names of the tables in the application's part of the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in files.listStatus(folder)} if files.exists(folder) else set()


def test_rarest_hits_lose_no_pair(spark):
    """Texts of common passages, of which each hash is in many texts, and close copies of some."""
    r = random.Random(12)
    passages = [prose(8000 + i, 40) for i in range(6)]
    texts = []
    for i in range(60):
        own = " ".join([*r.sample(passages, r.choice([2, 3, 4])), prose(9000 + i, r.choice([2, 5, 20, 60]))])
        texts.append(own)
        for _ in range(r.choice([0, 1, 2])):
            words = own.split()
            for _ in range(r.choice([1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(VOCABULARY)
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    for k, percent in ((5, 80), (3, 90)):
        got = jaccard_join.join_components(odd(spark, rows), k, percent).collect()
        assert key((x.doc_id, x.n_shingles, x.component_id) for x in got) == key(joined(rows, k, percent))


def test_plausible_equals_all_pairs():
    r = np.random.default_rng(4)
    for percent in (80, 90):
        base = r.poisson(2, (12, 512))
        counts = np.minimum(np.maximum(0, base[r.integers(0, 12, 90)] + r.poisson(0.04, (90, 512)) - r.poisson(0.02, (90, 512))), 255).astype(np.uint8)
        sizes, side = counts.sum(axis=1).astype(np.int64), r.random(90) < 0.4
        for where in (None, side):
            want = np.zeros(90, bool)
            for i in range(90):
                for j in range(i):
                    apart = np.abs(counts[i].astype(int) - counts[j]).sum()
                    fits = 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]) and apart * (100 + percent) <= (sizes[i] + sizes[j]) * (100 - percent)
                    if fits and (where is None or where[i] != where[j]):
                        want[[i, j]] = True
            assert (jaccard_join.plausible(counts, sizes, percent, where) if where is not None else jaccard_join.plausible(counts, sizes, percent)).tolist() == want.tolist()
            assert 0 < want.sum()


def test_jaccard_join_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert key(jaccard_join.op6_jaccard_join(spark, SF).collect()) == key(joined(rows, 3, 90))
    assert jaccard_join.join_components(odd(spark, [])).count() == 0


def test_region_plan_loses_no_pair():
    """Every linked pair shares a published hash in some class, and each enough of them."""
    r = random.Random(9)
    for percent in (80, 90):
        plan = jaccard_join.Plan(percent)
        for _ in range(400):
            n = r.choice([4, 7, 10, 20, 45, 100, 300])
            common = n - r.randint(0, max(1, n * (100 - percent) // 100))
            make = lambda m: [r.getrandbits(64) for _ in range(m)]
            base = make(common)
            a, b = (np.unique(np.array(base + make(r.randint(0, n - common)), np.uint64)) for _ in range(2))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < percent * (len(a) + len(b) - inter) or len(a) == len(b) == inter:
                continue
            pa, pb = ({(k, s): need for k, need, sigs in plan.published(x) for s in sigs.tolist()} for x in (a, b))
            shared = pa.keys() & pb.keys()
            assert any(sum(x[0] == k for x in shared) >= max(pa[k, s], pb[k, s]) for k, s in shared)


# -- 7 token files


def test_token_files(spark):
    lib = library(WORD)
    for df, rows in both(spark):
        folder = scratch_path(spark, "t")
        manifest = token_files.write_tokens(df, folder, WORD, file_bytes=4000)
        got = token_files.read_tokens(manifest).collect()
        line = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
        want, at = [], 0
        ids = {t: lib.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows}
        raw = {t: struct.pack(f"<{len(x)}I", *x) for t, x in ids.items()}
        assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((i, len(ids[t]), zlib.crc32(raw[t])) for i, t in rows)
        ends = sorted((r.start, r.n_tokens) for r in got)
        for start, n in ends:
            assert start == at
            at += n
        starts = {r.doc_id: r.start for r in got}
        proper = [i for i, _ in line if i is not None]
        assert all(starts[a] <= starts[b] for a, b in zip(proper, proper[1:], strict=False))
    one = rows[5][0]
    found = [x for m in manifest.collect() for x in token_files.read_documents(m.path, [one]).get(one, [])]
    assert found == [raw[dict(rows)[one]]]
    assert token_files.read_tokens(token_files.write_tokens(odd(spark, []), scratch_path(spark, "t"), WORD)).count() == 0


def test_token_file_damage_is_found(tmp_path):
    path = tmp_path / "f"
    with open(path, "wb") as stream:
        f = token_files.TokenFile(str(path), stream)
        for i in range(5):
            f.add(i if i else None, struct.pack("<3I", i, 2 * i, 7))
        f.close()
    assert [i for i, _ in token_files.read_file(str(path))] == [None, 1, 2, 3, 4]
    data = bytearray(path.read_bytes())
    data[len(data) - 9 - 12 * 5 + 8] ^= 1  # the first frame's checksum
    path.write_bytes(data)
    with pytest.raises(ValueError):
        token_files.read_documents(str(path), [None])
    assert token_files.read_documents(str(path), [3]) == {3: [struct.pack("<3I", 3, 6, 7)]}


# -- 8 licences


def test_license_scan(spark):
    for df, rows in both(spark):
        want = []
        for i, t in rows:
            words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            places = [(p, label) for phrase, label in license_scan.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
            at = [p for p, _ in places]
            want.append((i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
        got = license_scan.scan(df).collect()
        assert key(tuple(r)[:6] for r in got) == key(want)
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan(odd(spark, [])).count() == 0


def test_license_templates(spark):
    full = license_scan.TEMPLATES["mit-text"][1]
    rows = [(1, "intro " + full.title()), (2, full.replace("free of charge", "for money")), (3, "Licensed under the Apache License, Version 2.0."),
            (4, "mit license mit license"), (5, "permission is hereby granted free of charge"), (6, full + " " + license_scan.TEMPLATES["bsd-text"][1])]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(odd(spark, rows)).collect()}
    assert got == {1: ("mit-text", 1.0), 2: ("", 0.0), 3: ("apache,apache-2.0", 1.0), 4: ("mit", 0.5), 5: ("", 0.0), 6: ("bsd-text,mit-text", 1.0)}


def test_license_short_creative_commons(spark):
    """Against a search for the longest short form at each place."""
    kinds, r = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"], random.Random(8)
    forms = [f"CC {x.upper()}{v}" for x in kinds for v in ("", " 1.0", " 2.0", " 2.5", " 3.0", " 4.0", " 9.0")]
    texts = [f"{prose(i, 5)} Licensed under {x}{end} {prose(i + 500, 5)}" for i, x in enumerate(forms) for end in (".", "", "!")]
    texts += [f"({x.replace(' ', '-')})" for x in forms] + [x.lower() for x in forms] + ["please cc by friday", "cc", "by nc 4.0", "cc by nc\n4 0"]
    texts += [prose(i, 20) + " " + r.choice(forms) + " " + r.choice(forms) + ", " + r.choice(forms) for i in range(40)]
    stored = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    pattern = re.compile(r"(?<![^ ])cc by( nc sa| nc nd| nc| sa| nd|)( [1234] 0| 2 5|)(?![^ ])")

    def wanted(text):
        words = " ".join(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        out = set()
        for m in pattern.finditer(words):
            version = m[2].strip().replace(" ", ".")
            label = "cc-by" + m[1].replace(" ", "-") + (f"-{version}" if version else "")
            if label != "cc-by":
                out.add(label)
            elif re.search(r"(?<![^ ])(licensed [^ ]+|[^ ]+ under) $", words[: m.start()]):
                out.add("cc-by-notice")
        return out

    rows = [*enumerate(texts), *((10_000 + i, t) for i, t in stored)]
    got = license_scan.scan(odd(spark, rows)).collect()
    assert {x.doc_id: {y for y in x.labels.split(",") if y.startswith("cc")} for x in got} == {i: wanted(t) for i, t in rows}
    assert all(x.score == 1 for x in got if "cc-by-nc-4.0" in x.labels.split(","))
    assert {y for i, t in rows for y in wanted(t)} >= {f"cc-{x}-4.0" for x in kinds} | {"cc-by-nc", "cc-by-notice"}


# -- 9 packing


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing(spark):
    lib = library(BYTE)
    for df, rows in both(spark):
        got = packing.pack_documents(df).collect()
        want = []
        for i, t in rows:
            ids, at, piece = lib.encode(t or "", add_special_tokens=False).ids + [0], 0, 0
            stop = (len(ids) - 1) % 2048 + 1
            while at < len(ids):
                want.append((i, piece, at, stop - at, zlib.crc32(struct.pack(f"<{stop - at}I", *ids[at:stop]))))
                at, stop, piece = stop, stop + 2048, piece + 1
        assert key(tuple(r)[:5] for r in got) == key(want)
        total = sum(r.length for r in got)
        assert check_packing(got, 2048) <= math.ceil(total / 2048) + 1
    assert packing.pack_documents(odd(spark, [])).count() == 0


def test_plan_is_best_fit_decreasing():
    """The same sequences as document-by-document best fit, also where a size has few documents."""
    r, cases = random.Random(8), [(13, {4: 4, 3: 3})]
    for _ in range(400):
        capacity = r.choice([5, 10, 33, 60])
        cases.append((capacity, {s: r.choice([1, 1, 2, 3, r.randint(1, 30)]) for s in r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 12)))}))
    for capacity, counts in cases:
        gaps, want = [], []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fit = min((g for g in gaps if g >= size), default=None)
                want.append((size, capacity - (fit or capacity)))
                if fit is None:
                    gaps.append(capacity - size)
                else:
                    gaps[gaps.index(fit)] -= size
        seqs, ranks = {}, {}
        plan = packing.plan(counts, capacity)
        for size, rank, n, first, offset in plan:
            ranks.setdefault(size, []).extend(range(rank, rank + n))
            for seq in range(first, first + n):
                seqs.setdefault(seq, []).append((offset, size))
        assert sorted(seqs) == list(range(len(gaps)))
        for pieces in seqs.values():
            ends = [0, *[o + s for o, s in sorted(pieces)]]
            assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= capacity
        assert sorted((s, o) for p in seqs.values() for o, s in p) == sorted(want)
        assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}


# -- 10 substring dedup


def deduped(rows, span=50):
    """(id, words, removed, hash of the rest)."""
    texts = [(i, re.findall(SPACE, t or "")) for i, t in rows]
    low = -(1 << 63)
    first = {}
    for i, w in texts:
        for p in range(len(w) - span + 1):
            s = tuple(w[p : p + span])
            first[s] = min(first.get(s, 1 << 62), low if i is None else i)
    out = []
    for i, w in texts:
        gone = {q for p in range(len(w) - span + 1) if first[tuple(w[p : p + span])] < (low if i is None else i) for q in range(p, p + span)}
        rest = [x for q, x in enumerate(w) if q not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(rest).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("per_task", [1000, 2])
def test_substring_dedup(spark, per_task, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANCHOR_ROWS", per_task)
    rows = list(ODD)
    r = random.Random(12)
    base = prose(50, 400).split()
    for n in range(30):
        a = r.randrange(300)
        part = base[a : a + r.randint(45, 120)]
        rows.append((50 + n, " ".join([*prose(200 + n, r.randint(0, 60)).split(), *part, *prose(300 + n, r.randint(0, 60)).split()])))
    assert key(substring_dedup.digests(odd(spark, rows)).collect()) == key(deduped(rows))
    kept = substring_dedup.remove_repeats(odd(spark, rows))
    assert kept.columns == odd(spark).columns
    texts = key((x.doc_id, hashlib.sha256(" ".join(re.findall(SPACE, x.text or "")).encode()).hexdigest()) for x in kept.collect())
    assert texts == key((i, h) for i, _, _, h in deduped(rows))


def test_substring_dedup_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert key(substring_dedup.op10_substring_dedup(spark, SF).collect()) == key(deduped([(r.doc_id, r.text) for r in docs.collect()]))
    assert substring_dedup.digests(odd(spark, [])).count() == 0
