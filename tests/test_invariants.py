"""Invariants: probabilities sum to one, counts add up, partition independence,
edge rows (NULL keys, all-NULL attributes, empty table)."""

from pyspark.sql import functions as F

from conftest import SF001, SF01
from plurality.operators import scoring, shares
from plurality.operators.ensemble import scenario_sums
from plurality.plans import standard as S
from plurality.sources import profiles

RULE = S.STANDARD_RULE


def test_probabilities_sum_to_one(spark):
    p = scoring.probabilities(profiles.order_profile(spark, SF001), RULE, keep=[])
    worst = p.select(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1)).alias("e")).first().e
    assert worst < 1e-12


def test_sampled_one_hot_and_counts(spark):
    p = scoring.probabilities(profiles.order_profile(spark, SF001), RULE, mode="sampled", keep=[])
    r = p.agg(F.count("*").alias("n"), F.sum(F.col("p0") + F.col("p1") + F.col("p2")).alias("s")).first()
    assert r.s == r.n
    c = shares.apportioned_counts(p, RULE).collect()
    assert sum(x["count"] for x in c) == r.n


def test_apportion_sums_to_n(spark):
    p = scoring.probabilities(profiles.order_profile(spark, SF01), RULE)
    rows = shares.apportioned_counts(p, RULE).collect()
    assert sum(r["count"] for r in rows) == rows[0]["n"] == 15000


def test_breakdown_counts_sum_to_n(spark):
    p = scoring.probabilities(profiles.order_profile(spark, SF01), RULE)
    b = shares.breakdown(p, RULE, S.ORDER_CATALOG).where("choice_index = 0")
    for r in b.groupBy("group_attribute").agg(F.sum("n").alias("n")).collect():
        assert r.n == 15000
    unknown = {r.group_value: r.n for r in b.where("group_attribute = 'basket'").collect()}
    assert unknown["Unknown"] == 3249 + 257


def test_partition_independence(spark):
    prof = profiles.order_profile(spark, SF01)
    base = None
    for parts in (1, 4, 16):
        res = sorted(tuple(r) for r in shares.shares(scoring.probabilities(prof.repartition(parts), RULE), RULE).collect())
        base = base or res
        assert res == base


def test_segments_by_arity_and_from_a_shared_cube_agree(spark):
    p = scoring.probabilities(profiles.order_profile(spark, SF01), RULE)
    a = sorted(tuple(r) for r in shares.segments(p, RULE, S.ORDER_CATALOG).collect())
    b = sorted(tuple(r) for k in (1, 2) for r in shares.segments(p, RULE, S.ORDER_CATALOG, arities=(k,)).collect())
    cells = shares.cube(p, RULE, S.ORDER_CATALOG, RULE.result_groups, (1, 2))
    c = sorted(tuple(r) for r in shares.segments(None, RULE, S.ORDER_CATALOG, cells=cells).collect())
    assert a == b == c and len(a) > 0


def test_null_keys_are_counted(spark):
    df = spark.createDataFrame([("a", "1-URGENT"), (None, "1-URGENT"), ("b", None), (None, None)], "unit_id string, priority string")
    df = df.selectExpr("*", "'large' AS basket", "CAST(NULL AS STRING) AS segment")
    for mode in ("expected", "sampled"):
        rows = shares.shares_with_counts(scoring.probabilities(df, RULE, keep=[], mode=mode, null_keys=True), RULE).collect()
        assert {(r.n_rows, r.n_scored, r.n_null_key) for r in rows} == {(4, 2, 2)}
        plain = shares.shares(scoring.probabilities(df, RULE, keep=[], mode=mode), RULE).collect()
        assert [(r.choice, r.total, r.percent) for r in rows] == [(r.choice, r.total, r.percent) for r in plain]
    assert shares.row_counts(df).first() == (4, 2, 2)


def test_empty_key_lists(spark):
    from plurality.operators.evidence import coverage

    df = spark.createDataFrame([("a", "x")], "unit_id string, k string")
    assert coverage(df, []).count() == 0
    assert shares.top_factors(shares.factor_effects(spark, [], RULE.choice_ids)).count() == 0
    assert shares.missing_cells(df, []).first() == (1, 0)
    plain = RULE.with_factors(())
    assert shares.segments(scoring.probabilities(df, plain, keep=[]), plain, S.ORDER_CATALOG).count() == 0


def test_sampled_grid_equals_sampled_rules(spark):
    prof, ens = profiles.order_profile(spark, SF001), S.STANDARD_ENSEMBLE
    grid = {(r.prior_id, r.perspective_id, r.choice): r.total for r in scenario_sums(prof, ens, mode="sampled").collect()}
    for prior in ens.priors:
        for persp in ens.perspectives:
            rule = ens.rule_for(persp, prior.base_scores)
            t = shares.totals(scoring.probabilities(prof, rule, keep=[], mode="sampled"), 3).first()
            assert [grid[(prior.id, persp.id, c)] for c in rule.choice_ids] == [t[f"t{i}"] for i in range(3)]


def test_null_keys_excluded_and_null_attributes_score(spark):
    df = spark.createDataFrame(
        [("a", None, None, None), (None, "1-URGENT", "large", "BUILDING"), ("b", "1-URGENT", "large", "BUILDING")],
        "unit_id string, priority string, basket string, segment string",
    )
    p = scoring.probabilities(df, RULE, keep=[])
    rows = {r.unit_id: r for r in p.collect()}
    assert set(rows) == {"a", "b"}
    assert abs(sum(rows["a"][1:]) - 1) < 1e-12


def test_empty_table_gives_null_shares(spark):
    df = spark.createDataFrame([], "unit_id string, priority string, basket string, segment string")
    rows = shares.shares(scoring.probabilities(df, RULE, keep=[]), RULE).collect()
    assert all(r.n == 0 and r.percent is None for r in rows)


def test_scenario_grid_single_scan_matches_separate_rules(spark):
    prof = profiles.order_profile(spark, SF001)
    ens = S.STANDARD_ENSEMBLE
    grid = {(r.prior_id, r.perspective_id, r.choice): r.total for r in scenario_sums(prof, ens).collect()}
    for prior in ens.priors:
        for persp in ens.perspectives:
            rule = ens.rule_for(persp, prior.base_scores)
            t = shares.totals(scoring.probabilities(prof, rule, keep=[]), 3).first()
            for i, c in enumerate(rule.choice_ids):
                assert abs(grid[(prior.id, persp.id, c)] - t[f"t{i}"]) < 1e-9


def test_score_by_join_keeps_duplicate_keys_apart(spark):
    df = spark.createDataFrame(
        [("k", "1-URGENT", "large", "BUILDING"), ("k", None, "medium", None), ("k", "5-LOW", None, "BUILDING"), ("m", None, None, None)],
        "unit_id string, priority string, basket string, segment string",
    )
    ft = scoring.factor_table(spark, RULE)
    a = sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in scoring.score_by_join(df, RULE, ft).collect())
    b = sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in scoring.score(df, RULE, keep=[]).collect())
    assert a == b and len(a) == 4


def test_draw_suffix_can_be_kept_apart(spark):
    from plurality.spec import Choice, Rule

    rule = Rule("q", (Choice("sample"), Choice("other")), {"sample": 0.5, "other": 0.5}, (), (), S.STANDARD_SEED)
    df = profiles.order_profile(spark, SF001)
    a = shares.shares(scoring.probabilities(df, rule, mode="sampled", keep=[]), rule).collect()
    b = shares.shares(scoring.probabilities(df, rule, mode="sampled", keep=[], draw_suffix="#draw"), rule).collect()
    assert sum(r.total for r in a) == sum(r.total for r in b) == 1500
