"""The pipeline stage by stage against brute force, and end to end."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from plurality.llm import quality_model, queries
from pyspark.sql import functions as F
from test_llm_operators import BYTE, ODD, SF, SPACE, check_packing, deduped, joined, library, metrics, odd


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage over the test table and the awkward rows."""
    base = tmp_path_factory.mktemp("pipeline")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = odd(spark).select(*table.columns).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs, out = table.unionByName(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        result = spark.read.parquet(f"{base}/{name}")
        out[name] = (docs, result)
        docs = result
    return out


def test_stage_order_and_columns(stages, spark):
    names = ["quality_rules", "quality_classifier", "near_duplicates", "substring_dedup", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) == names
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[n][1].columns == columns for n in names[:-1])


def test_rules_stage(stages):
    before, after = stages["quality_rules"]

    def passes(text):
        n, _, _, _, repeated = metrics(text)
        return n >= 20 and 100 * repeated <= 30 * n

    assert rows_of(after) == Counter(tuple(r) for r in before.collect() if passes(r.text))


def test_classifier_stage(stages, spark):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = Counter(r.doc_id for r in quality_model.classify(before, labels).collect() if r.predicted)
    assert Counter(r.doc_id for r in after.collect()) == good
    # labelled good documents stay
    clean = {r.doc_id for r in labels.filter("quality = 1").collect()}
    lost = {r.doc_id for r in before.collect()} & clean - {r.doc_id for r in after.collect()}
    assert len(lost) <= 0.02 * len(clean)


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    component = {i: c for i, _, c in joined(rows, 5, 80)}
    kept = Counter(r.doc_id for r in after.collect())
    assert kept == Counter(set(component.values()) - {None}) + Counter({None: kept[None]})
    assert len(kept) < len(rows)


def test_substring_stage(stages):
    before, after = stages["substring_dedup"]
    want = Counter((i, n - gone) for i, n, gone, _ in deduped([(r.doc_id, r.text) for r in before.collect()]))
    assert Counter((r.doc_id, len(re.findall(SPACE, r.text or ""))) for r in after.collect()) == want
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)


def test_packing_stage(stages):
    before, after = stages["packing"]
    lib, want = library(BYTE), Counter()
    for r in before.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for a, b in zip([0, *range(first, len(ids), 2048)], [first, *range(first + 2048, len(ids) + 1, 2048)], strict=True):
            want[r.doc_id, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    rows = after.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 2048)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages["packing"][1].columns
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.count() > 0 and {r.doc_id for r in got.collect()} <= ids


def test_empty_table(spark):
    none = odd(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_registered_queries():
    assert {int(n[2:].split("_")[0]) for n in queries.REGISTRY} == set(range(1, 14))
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(queries.REGISTRY) <= set(entry.queries())
    assert len(ODD) > 15


def test_quality_rules_oracle(spark):
    from oracle_check import compare

    assert compare(spark, "op3_quality_rules", "/root/testdata/sf0.01")["ok"]
