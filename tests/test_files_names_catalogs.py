"""File integrity in blocks, row groups, catalogs as files, closest names, Unicode seeds, batch decoding, stored rules."""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01
from plurality.functions import text as T
from plurality.operators import audit, names, packed
from plurality.plans import standard as S
from plurality.plans.stored_rules import stored_rules
from plurality.sources import catalogs, files, integrity, profiles

# -- files in blocks


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    bodies = {"a.bin": rng.randbytes(100_000), "b.bin": rng.randbytes(4096), "c.bin": b"", "d.bin": rng.randbytes(4097), "e.bin": rng.randbytes(50_000)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    return tmp_path, bodies


def blocks_of(body, n=4096):
    return [hashlib.sha256(body[i : i + n]).hexdigest() for i in range(0, max(1, len(body)), n)]


def test_block_digests_of_files(spark, folder):
    path, bodies = folder
    listed = integrity.listed_files(spark, str(path), "*.bin")
    assert {r.file_name: r.bytes for r in listed.collect()} == {k: len(v) for k, v in bodies.items()}
    found = integrity.combined(integrity.block_digests(listed, 4096)).collect()
    assert {os.path.basename(r.path): list(r.blocks) for r in found} == {k: blocks_of(v) for k, v in bodies.items()}
    assert {os.path.basename(r.path): r.tree_sha256 for r in found} == {k: hashlib.sha256("".join(blocks_of(v)).encode()).hexdigest() for k, v in bodies.items()}
    whole = {os.path.basename(r.path): r.sha256 for r in integrity.stream_digests(listed, 1000).collect()}
    assert whole == {k: hashlib.sha256(v).hexdigest() for k, v in bodies.items()}


def test_blocks_of_one_file_go_to_many_tasks(spark, tmp_path):
    (tmp_path / "large.bin").write_bytes(bytes(1 << 20))
    digests = integrity.block_digests(integrity.listed_files(spark, str(tmp_path)), 1 << 14)
    assert digests.select(F.spark_partition_id().alias("p")).distinct().count() >= 6


def test_files_above_2_gib_are_read_by_range(spark, tmp_path):
    size = (2 << 30) + 5_000_000
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    listed = integrity.listed_files(spark, str(tmp_path))
    assert listed.first().bytes == size
    found = {r.block: r.sha256 for r in integrity.block_digests(listed, 512 << 20).collect()}
    assert len(found) == 5 and found[0] == found[1] == found[2] == found[3]
    tail = bytes(size - (4 * (512 << 20)) - 3) + b"end"
    assert found[4] == hashlib.sha256(tail).hexdigest()


def test_audit_finds_every_fault_and_its_blocks(spark, folder):
    path, bodies = folder
    rows = [(k, len(v), blocks_of(v), hashlib.sha256(v).hexdigest()) for k, v in bodies.items() if k != "b.bin"] + [("gone.bin", 3, ["0"], "0")]
    body = bytearray(bodies["a.bin"])
    body[4096 * 3 + 7] ^= 1
    body[-1] ^= 1
    (path / "a.bin").write_bytes(body)
    (path / "d.bin").write_bytes(bodies["d.bin"][:-1])
    manifest = spark.createDataFrame(rows, "file_name string, bytes long, blocks array<string>, sha256 string")
    want = {"a.bin": "hash_mismatch", "b.bin": "unlisted", "c.bin": "ok", "d.bin": "size_mismatch", "e.bin": "ok", "gone.bin": "missing"}
    by_block = integrity.audit_files(spark, manifest.drop("sha256"), str(path), "*.bin", 4096).collect()
    assert {r.file_name: r.status for r in by_block} == want
    assert {r.file_name: r.bad_blocks for r in by_block if r.bad_blocks} == {"a.bin": [3, 24]}
    whole = integrity.audit_files(spark, manifest.drop("blocks"), str(path), "*.bin", 4096).collect()
    assert {r.file_name: r.status for r in whole} == want
    sizes = integrity.completeness(manifest, integrity.listed_files(spark, str(path), "*.bin")).collect()
    assert {r.file_name: r.status for r in sizes} == {**want, "a.bin": "ok"}
    with pytest.raises(ValueError, match="a.bin: hash_mismatch"):
        integrity.require_files(spark, manifest.drop("sha256"), str(path), "*.bin", 4096)
    integrity.require_files(spark, manifest.drop("sha256").where("file_name IN ('c.bin', 'e.bin')"), str(path), "[ce].bin", 4096)


# -- row groups


def test_row_groups_of_100_000_rows(spark, tmp_path):
    path = files.write_parquet(spark.range(0, 250_000, 1, 1), str(tmp_path / "rows"))
    groups = sorted((r.row_group, r.rows, r.compression) for r in files.row_groups(spark, path).collect())
    assert groups == [(0, 100_000, "ZSTD"), (1, 100_000, "ZSTD"), (2, 50_000, "ZSTD")]
    assert files.row_group_audit(files.row_groups(spark, path)).first().asDict() == {"rows": 250_000, "row_groups": 3, "compression": "ZSTD", "oversized": 0, "uneven": 0}
    other = files.write_parquet(spark.range(0, 100, 1, 1), str(tmp_path / "few"), row_group_rows=30)
    assert [r.rows for r in files.row_groups(spark, other).orderBy("row_group").collect()] == [30, 30, 30, 10]
    assert files.row_group_audit(files.row_groups(spark, other), 25).first().oversized == 3


# -- catalogs


def catalog_on_disk(path, docs):
    os.makedirs(path / "attributes")
    for name, attributes in docs.items():
        (path / "attributes" / f"{name}.json").write_text(json.dumps({"domain": name, "attributes": attributes}, ensure_ascii=False, indent=1), encoding="utf-8")
    (path / "index.json").write_text(json.dumps({"domains": {n: {"file": f"attributes/{n}.json"} for n in docs}}, indent=1))
    return str(path / "index.json")


def test_catalog_files_load_with_roles(spark, tmp_path):
    docs = {"core": {"region": ["N", "S"], "age": ["young", "old's"]}, "food": {"cuisine": ["thaï", "None"], "empty": []}}
    got = catalogs.load_catalog(spark, catalog_on_disk(tmp_path, docs), ["region"], ["region", "age"]).collect()
    want = {(d, a, i, v, a == "region", a not in ("region", "age")) for d, attrs in docs.items() for a, vs in attrs.items() for i, v in enumerate(vs)}
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_duplicate_attributes_raise(spark, tmp_path):
    docs = {"core": {"region": ["N"], "age": ["x"]}, "food": {"age": ["y"]}, "more": {"region": ["Z"], "age": ["x"]}}
    index = catalog_on_disk(tmp_path, docs)
    found = {r.attribute: r.domains for r in catalogs.duplicate_attributes(catalogs.read_catalog(spark, index)).collect()}
    assert found == {"age": "core,food,more", "region": "core,more"}
    with pytest.raises(ValueError, match="duplicate catalog attribute: age"):
        catalogs.load_catalog(spark, index)


# -- names


def test_closest_names_equal_brute_force(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeiou") for _ in range(r.randint(2, 9))) for _ in range(700)]
    known = sorted({"_".join(r.choices(stems, k=r.randint(1, 3))) for _ in range(16_000)})[:10_000]
    assert len(known) == 10_000
    unknown = ["", "a", "ab", "zzzz"]
    for name in r.sample(known, 120):
        word = list(name)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(word) or 1)
            word[at : at + 1] = r.choice([[], [r.choice("abcxyz")], word[at : at + 1] * 2, [*word[at : at + 1], "q"]])
        unknown.append("".join(word))
    unknown = sorted(set(unknown) - set(known))
    got = {x.unknown: x.known for x in names.closest(spark.createDataFrame([(u,) for u in unknown], "unknown string"), spark.createDataFrame([(k,) for k in known], "known string")).collect()}
    want = {u: m[0] for u in unknown if (m := difflib.get_close_matches(u, known, n=1, cutoff=0.82))}
    assert got == want and len(want) > 60


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_bigram_bound_keeps_every_close_pair(a, b):
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    if ratio >= names.CUTOFF and a and b:
        grams = lambda s: Counter(s[i : i + 2] for i in range(max(1, len(s) - 1)))
        shared, total = sum((grams(a) & grams(b)).values()), len(a) + len(b)
        assert shared >= 1 and shared >= (1.5 * names.CUTOFF - 1) * total - 1 - 1e-9


def test_cutoffs_that_the_index_cannot_serve_are_refused(spark):
    one = spark.createDataFrame([("a",)], "unknown string")
    with pytest.raises(ValueError):
        names.closest(one, one.withColumnRenamed("unknown", "known"), 0.7)


# -- seeds


def test_unicode_seeds_equal_the_standard_library(spark):
    odd = ["", " ", "ﬁ ﬂ ﬀ ﬃ", "ＦＵＬＬ　ｗｉｄｔｈ", "Straße ẞ", "İı ǅ Σίσυφος ς", "①②Ⅷ ℌ ½ µ", "a b c　d e\x85f", "\x1ca\x1d\x1eb\x1f", "é é", "가 ᄀ", "ﷺ", "\t tab\nline\r\n", None]
    docs = [r.text for r in profiles.table(spark, SF01, "documents").select("text").collect()]
    rows = list(enumerate(odd + docs))
    df = spark.createDataFrame(rows, "i int, t string").select("i", T.canonical_text(F.col("t")).alias("c"), T.seed_text(F.col("t")).alias("s"))
    for r in df.collect():
        t = rows[r.i][1]
        want = None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split())
        assert r.c == want, (t, r.c)
        assert r.s == (None if t is None else hashlib.sha256(want.encode()).hexdigest())


# -- batch decoding


@pytest.mark.parametrize("short", ["null", "zero"])
def test_batches_decode_like_expressions(spark, short):
    from plurality.plans.queries import PACKED_FIELDS

    narrow = profiles.packed_profile(spark, SF01)
    lists = F.expr("""CASE source_row_index % 5 WHEN 0 THEN array(NULL, named_struct('field_index', CAST(NULL AS INT), 'value', 'lost'), named_struct('field_index', 7, 'value', 'won'),
        named_struct('field_index', 7, 'value', 'late'), named_struct('field_index', 99, 'value', 'none')) WHEN 1 THEN array() WHEN 2 THEN NULL ELSE attribute_overrides END""")
    dirty = narrow.withColumns({"attribute_overrides": lists, "attributes": F.when(F.col("doc_id") % 13 != 0, F.col("attributes")),
                                "null_bitmap": F.when(F.col("doc_id") % 17 == 0, F.unhex(F.lit("FF"))).otherwise(F.col("null_bitmap"))})
    names_ = [n for i, (n, _) in enumerate(PACKED_FIELDS) if i % 3 != 1]
    for df, select in ((narrow, None), (dirty, names_), (dirty.limit(0), None)):
        a = packed.decode_wide(df, PACKED_FIELDS, select, short, keep=["doc_id"])
        b = packed.decode_batches(df, PACKED_FIELDS, select, short, keep=["doc_id"])
        assert a.columns == b.columns and a.dtypes == b.dtypes
        assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


# -- stored rules


def test_many_stored_rules_are_audited_in_one_job(spark):
    """100,000 rules derived from a range; findings of a sample equal those of the same rules one by one."""
    orders = spark.range(0, 100_000).select(F.col("id").alias("o_orderkey"))
    found = audit.audit_stored(spark, stored_rules(orders), S.ORDER_CATALOG, None, S.TESTDATA_CLASSIFIER.sensitive_pattern)
    counts = {r.check: r["count"] for r in found.groupBy("check").count().collect()}
    assert counts["A1 choice_count"] == sum(k % 11 == 0 for k in range(100_000))
    assert counts["A7 interactions"] == sum(k % 17 == 0 for k in range(100_000))
    assert counts["S max_factors"] == sum(k % 19 == 0 and k % 5 != 0 for k in range(100_000))
    assert counts["A10 evidence_and_hybrid"] == sum(k % 50 == 0 for k in range(100_000))
    assert counts["A11 perspective_count"] == sum(k % 5 == 0 and k % 3 == 0 for k in range(100_000))


def test_stored_rules_give_the_findings_of_configured_ones(spark):
    """The audit rules of the configuration, stored as rows of nested columns, give the same findings."""
    from plurality.spec import Ensemble

    rows = []
    for rid, r in S.AUDIT_RULES.items():
        fs = lambda factors: [(f.attribute, list(f.conditions), dict(f.effects)) for f in factors]
        ens = isinstance(r, Ensemble)
        rows.append((rid, "ensemble" if ens else "rule", r.choices and [c.id for c in r.choices], dict(r.base_scores), [] if ens else fs(r.factors), list(r.result_groups),
                     len(getattr(r, "interactions", ()) or ()), [(p.id, fs(p.factors)) for p in r.perspectives] if ens else None,
                     [(p.id, dict(p.base_scores)) for p in r.priors] if ens else None, ens and r.has_hybrid,
                     r.central_prior_id if ens else None, r.fit_only_prior_id if ens else None, list(r.excluded_direct_attributes) if ens else None,
                     {c: [(s.attribute, list(s.conditions)) for s in sels] for c, sels in r.evidence.selectors.items()} if ens and r.evidence else None))
    stored = spark.createDataFrame(rows, audit.STORED_RULE)
    pattern = S.TESTDATA_CLASSIFIER.sensitive_pattern
    a = Counter(map(tuple, audit.audit_stored(spark, stored, S.ORDER_CATALOG, None, pattern).collect()))
    b = Counter(map(tuple, audit.audit(spark, S.AUDIT_RULES, S.ORDER_CATALOG, None, pattern).collect()))
    assert a == b and len(a) > 20


def _odd_rules(n: int, seed: int) -> list[tuple]:
    """Stored rules with NULLs, empty lists and repeated names in every place."""
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    some = lambda f, most: pick(None, *[[f() for _ in range(rng.randint(0, most))] for _ in range(4)])
    choice = lambda: pick("a", "b", "c", "sample", None)
    name = lambda: pick("priority", "priorty", "basket", "c_phone", "planet", None)
    value = lambda: pick("1-URGENT", "large", "9-NEVER", None)
    scores = lambda: pick(None, {k: pick(0.5, 0.3, 0.2, -0.1, 0.4, None) for k in "abcd"[:rng.randint(0, 4)]})
    factor = lambda: (name(), some(value, 3), scores())
    rows = []
    for i in range(n):
        evidence = pick(None, {k: some(lambda: (name(), some(value, 2)), 5) for k in "abq"[:rng.randint(0, 3)]})
        rows.append((f"r{i}", pick("rule", "ensemble", "ensemble", None), some(choice, 5), scores(), some(factor, 15), some(lambda: pick("region", "status", "moon", None), 5),
                     pick(None, 0, 2), some(lambda: (pick("p1", "p2", "p3", None), some(factor, 8)), 5), some(lambda: (pick("x", "y", "z", None), scores()), 5),
                     pick(None, True, True, False), pick("x", "nope", None), pick("x", "y", None), some(name, 3), evidence))
    return rows


def test_findings_of_single_rules_equal_those_of_the_flat_tables(spark, monkeypatch):
    """Rules whose ids occur once, repeated and NULL ids, and lookup tables too large to broadcast: all as the joins over the flat tables find them."""
    pattern = S.TESTDATA_CLASSIFIER.sensitive_pattern
    profile = spark.createDataFrame([("1-URGENT", "small"), (None, "small")], "priority string, basket string")
    for rows, most in ((_odd_rules(400, 1), None), ([(r[0] if i % 3 else None if i % 2 else "r1", *r[1:]) for i, r in enumerate(_odd_rules(60, 2))], 0)):
        stored = spark.createDataFrame(rows, audit.STORED_RULE).cache()
        want = Counter(map(tuple, audit.audit_tables(spark, audit.rule_tables(stored), S.ORDER_CATALOG, profile, pattern).collect()))
        if most is not None:
            monkeypatch.setattr(audit, "BROADCAST_MAX_BYTES", most)
        got = Counter(map(tuple, audit.audit_stored(spark, stored, S.ORDER_CATALOG, profile, pattern).collect()))
        assert got == want and len({check for _, check, _ in got}) > 30


def test_single_rules_are_audited_without_a_shuffle(spark):
    """Most rules have one of few attributes and conditions; no rows are dealt by them, or by anything."""
    orders = spark.range(0, 2000).select(F.col("id").alias("o_orderkey"))
    profile = spark.createDataFrame([("1-URGENT",)], "priority string")
    found = audit.audit_stored(spark, stored_rules(orders), S.ORDER_CATALOG, profile, S.TESTDATA_CLASSIFIER.sensitive_pattern)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert {"A3 unknown_attribute", "A4 unobserved_condition"} <= {r.check for r in found.select("check").distinct().collect()}
