"""Manifest audit failure modes, catalog JSON load, classification branches,
evidence semantics, and the hashing of the driver-side seed."""

import hashlib
import json
import os
import tempfile

from pyspark.sql import functions as F

from plurality.spec import document_seed
from plurality.operators.dictionary import PERSONA_CLASSIFIER, classify, domain_index
from plurality.operators.evidence import coverage, empirical_prior, evidence_report
from plurality.sources.files import file_digests, load_catalog_json, manifest_audit
from plurality.spec import Evidence, Selector


def test_manifest_audit_statuses(spark):
    d = tempfile.mkdtemp(prefix="plurality-test-")
    for name, body in (("a.bin", b"hello"), ("b.bin", b"world!"), ("c.bin", b"same")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame(
        [("a.bin", 5, sha(b"hello")), ("b.bin", 99, sha(b"world!")), ("c.bin", 4, sha(b"diff")), ("gone.bin", 1, "00")],
        "file_name string, bytes bigint, sha256 string")
    got = {r.file_name: r.status for r in manifest_audit(spark, manifest, d, "*.bin").collect()}
    assert got == {"a.bin": "ok", "b.bin": "size_mismatch", "c.bin": "hash_mismatch", "gone.bin": "missing"}
    digests = {r.file_name: r.sha256 for r in file_digests(spark, d, "*.bin").collect()}
    assert digests["a.bin"] == sha(b"hello")


def test_load_catalog_json_and_duplicates(spark):
    d = tempfile.mkdtemp(prefix="plurality-cat-")
    os.makedirs(os.path.join(d, "attributes"))
    docs = {"core": {"region": ["N", "S"], "age": ["young", "old"]}, "food": {"cuisine": ["thai", "none"], "age": ["x"]}}
    for name, attrs in docs.items():
        with open(os.path.join(d, "attributes", f"{name}.json"), "w") as f:
            json.dump({"domain": name, "attributes": attrs}, f)
    with open(os.path.join(d, "index.json"), "w") as f:
        json.dump({"domains": {n: {"file": f"attributes/{n}.json"} for n in docs}}, f)
    long, dups = load_catalog_json(spark, os.path.join(d, "index.json"))
    rows = {(r.domain, r.attribute, r.code, r.value) for r in long.collect()}
    assert ("core", "region", 1, "S") in rows and ("food", "cuisine", 0, "thai") in rows
    assert [r.attribute for r in dups.collect()] == ["age"]
    from plurality.spec import Catalog

    cat = Catalog.from_frame(long.where("domain = 'core'"), breakdowns=("region",), non_segment=("region",))
    assert cat.values("region") == ["N", "S"] and cat.values("age") == ["young", "old"]
    assert cat.domains["age"] == "core" and not cat.is_segment("region") and cat.is_segment("age")


def test_persona_classifier_branches(spark):
    fields = spark.createDataFrame([
        (0, "religion_level", "Religion", "Values & Motivation"),   # sensitive
        (1, "region", "Region", "Demographics"),                    # core id
        (2, "topic_wine", "Wine", "Interests: Food"),               # extra id
        (3, "big5_open", "Openness", "Personality: Big Five"),      # category
        (4, "cuis_thai", "Thai food", "Interests: Food"),           # category
        (5, "pref_x", "Travel style", "Other"),                     # pattern on label
        (6, "misc", "Nothing", "Other"),                            # unmatched
        (7, "region", "Region again", "Demographics"),              # duplicate
    ], "field_index int, id string, label string, category string")
    got = {r.field_index: (r.domain, r.reason) for r in classify(fields, PERSONA_CLASSIFIER).collect()}
    assert got == {0: (None, "sensitive"), 1: ("core", "core_id"), 2: ("food", "extra_id"),
                   3: ("decision-values", "category"), 4: ("food", "category"), 5: ("consumer-adventure", "pattern"),
                   6: (None, "unmatched"), 7: (None, "duplicate")}
    idx = {r.domain: r.attribute_count for r in domain_index(spark, classify(fields, PERSONA_CLASSIFIER), PERSONA_CLASSIFIER).collect()}
    assert idx["sports-outdoors"] == 0 and idx["food"] == 2 and len(idx) == 7


def test_evidence_three_valued_and_zero_match_fallback(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", None, None), ("3", "y", "z")], "unit_id string, a string, b string")
    ev = Evidence({"c1": (Selector("a", ("x",)), Selector("b", ("q",))), "c2": (Selector("b", ("z",)),)})
    rep = {r.choice: r for r in evidence_report(df, ev, ["c1", "c2"]).collect()}
    assert (rep["c1"].matched, rep["c1"].valid, rep["c1"].missing) == (1, 2, 1)
    assert (rep["c2"].matched, rep["c2"].valid) == (1, 1)
    assert rep["c1"].any_match == 2
    none = Evidence({"c1": (Selector("a", ("nope",)),), "c2": (Selector("b", ("nope",)),)})
    pri = {r.choice: (r.prior, r.source) for r in empirical_prior(df, none, ["c1", "c2"], {"c1": 0.6, "c2": 0.4}).collect()}
    assert pri == {"c1": (0.6, "authored"), "c2": (0.4, "authored")}
    cov = coverage(df, [("b", ("q",))]).first()
    assert cov.valid == 1 and cov.matched == 0 and cov.matched_pct_valid == 0.0


def test_document_seed():
    assert document_seed({"question": "  Hello\tWORLD "}) == hashlib.sha256(b"hello world").hexdigest()
    assert document_seed({"question": "\uff28ello \u00a0STRASSE"}) == document_seed({"question": "hello stra\u00dfe"})
    assert document_seed({"question": "ignored", "seed": "ab"}) == hashlib.sha256(b"ab").hexdigest()


def test_sink_roundtrip_zstd_summary(spark):
    import glob

    import pyarrow.parquet as pq

    from plurality.sources.files import sink_roundtrip

    df = spark.range(2500).select(F.col("id").cast("string").alias("unit_id"), (F.col("id") % 3).cast("string").alias("a"))
    back, summary = sink_roundtrip(spark, df, "test-sink")
    s = summary.first()
    assert s.rows == 2500 and s.attributes == "a,unit_id" and s.compression == "zstd"
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    path = s.path[len("file:"):] if s.path.startswith("file:") else s.path
    parts = glob.glob(os.path.join(path, "*.parquet"))
    assert parts
    meta = pq.ParquetFile(parts[0]).metadata
    assert meta.row_group(0).column(0).compression == "ZSTD"
