"""Rows that are repeated thousands of times, columns of any name, labels of one class."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plurality.llm import chunk_bpe, fingerprints, jaccard_join, quality_model, quality_rules, substring_dedup, tokens

REPEATS = 5000


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def repeated(spark):
    """One row 5,000 times, another document with its text, and ten others."""
    rows = [(7, prose(7, 90))] * REPEATS + [(8, prose(7, 90))] + [(100 + i, prose(100 + i, 80)) for i in range(10)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()


def test_chunks_of_repeated_rows(spark, repeated):
    rows, df = repeated
    path = tokens.tokenizer_path(chunk_bpe.VOCABULARY)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in chunk_bpe.digests(df, path).collect())
    lib = tokens.UnitEncoder(path).lib
    want = Counter()
    for (i, text), n in Counter(rows).items():
        ids = lib.encode(text, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += n
    assert got == want


def test_join_of_repeated_rows(spark, repeated):
    rows, df = repeated
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.join_components(df).collect())
    assert got == Counter((i, 7 if i == 8 else i) for i, _ in rows)
    assert jaccard_join.keep_first(df, 5, 80).count() == 11


def test_passages_of_repeated_rows(spark, repeated):
    rows, df = repeated
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digests(df).collect())
    assert got == Counter((i, len(t.split()), 90 if i == 8 else 0) for i, t in rows)


def test_fingerprints_of_repeated_rows(spark, repeated):
    rows, df = repeated
    got = fingerprints.compare_versions(df).select("doc_id", "fingerprint").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert len({r.fingerprint for r in got}) == 11


CLASHES = ["_row", "_tie", "_id", "_at", "_copy", "row", "tie", "id", "copy", "at", "doc", "left", "first", "node", "s1", "n_words", "score", "kept", "_1"]


def with_clashes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_foreign_columns(spark, tmp_path, stage):
    shared = prose(1, 60)
    rows = [(i, prose(10 + i, 60) + " " + (shared if i % 3 == 0 else ""), "en", "s", 9) for i in range(20)]
    rows += [(50, rows[4][1], "en", "s", 9), (51, None, "en", "s", None), (52, "", None, "s", 0)]
    docs = with_clashes(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = out.collect()
    assert kept
    for r in kept:
        assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASHES)



@pytest.mark.parametrize("quality", [0, 1, None])
def test_labels_of_one_class_keep_all(spark, quality):
    docs = with_clashes(spark, [(i, prose(i, 30), "en", "s", 9) for i in range(30)])
    labels = spark.createDataFrame([(i, quality, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality_model.keep_documents(docs, labels).count() == 30


def test_only_labels_of_the_rows_at_hand_count(spark):
    """Labels of documents that are gone neither fill the sample nor weigh the classes; a hot id gives one row."""
    good, bad = [(i, prose(i, 40)) for i in range(40)], [(100 + i, "### $$$ |||| " * 20 + prose(i, 3)) for i in range(40)]
    docs = spark.createDataFrame(good + bad + [bad[0]] * 300, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1000 + i, 0) for i in range(3000)], "doc_id long, quality int")
    seen = {}
    fit = quality_model.fit

    def spy(rows, y, weights):
        seen["n"], seen["weights"] = len(rows), weights
        return fit(rows, y, weights)

    quality_model.fit = spy
    try:
        kept = {r.doc_id for r in quality_model.keep_documents(docs, labels).collect()}
    finally:
        quality_model.fit = fit
    assert seen["n"] <= 80 and max(seen["weights"]) < 2
    assert len(kept & {i for i, _ in good}) >= 38 and len(kept & {i for i, _ in bad}) <= 2


def test_learned_cutoffs_reject_rows(spark):
    """With enough labelled good documents a cutoff is proven, and rows beyond it go."""
    n = 4200
    rows = [(i, prose(i % 50, 25), "en") for i in range(n)] + [(n + i, " ".join(f"#$%&|{w}" for w in prose(i, 40).split()), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_documents(docs, labels).select("doc_id").collect()}
    assert kept == set(range(n))
    few = {r.doc_id for r in quality_rules.keep_documents(docs, labels.filter("doc_id < 500")).select("doc_id").collect()}
    assert few == {i for i, _, _ in rows}
