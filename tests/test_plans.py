"""Plan-shape checks: the properties the scale design relies on."""

from conftest import SF01
from plurality.operators import scoring, shares
from plurality.operators.ensemble import scenario_sums
from plurality.plans import standard as S
from plurality.sources import profiles


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_md5_per_row_and_choice(spark):
    prof = profiles.order_profile(spark, SF01)
    exp = shares.shares(scoring.probabilities(prof, S.STANDARD_RULE), S.STANDARD_RULE)
    assert optimized(exp).count("md5(") == 3
    smp = shares.shares(scoring.probabilities(prof, S.STANDARD_RULE, mode="sampled"), S.STANDARD_RULE)
    assert optimized(smp).count("md5(") == 4


def test_scenario_grid_shares_noise_and_scans_once(spark):
    prof = profiles.order_profile(spark, SF01)
    grid = scenario_sums(prof, S.STANDARD_ENSEMBLE)          # 3 priors x 3 perspectives x 3 choices
    plan = optimized(grid)
    assert plan.count("md5(") == 3
    assert plan.count("Relation [o_orderkey") == 1           # orders read once


def test_scan_reads_only_needed_columns(spark):
    prof = profiles.order_profile(spark, SF01)
    plan = physical(shares.shares(scoring.probabilities(prof, S.STANDARD_RULE), S.STANDARD_RULE))
    orders_schema = [line for line in plan.split("\n") if "orders.parquet" in line][0]
    assert "o_totalprice" not in orders_schema and "o_orderdate" not in orders_schema


def test_no_python_udfs_or_cross_joins_in_registered_queries(spark):
    from plurality.plans.queries import REGISTRY

    for name, q in REGISTRY.items():
        if name in ("sink_roundtrip_zstd",):
            continue
        plan = physical(q(spark, SF01))
        if name == "unicode_seed":  # NFKC exists in Python only; only texts that are not ASCII go there, in Arrow batches
            assert plan.count("ArrowEvalPython") == 1 and "octet_length" in plan
            continue
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name  # no cross joins


def test_same_results_without_broadcast_joins(spark):
    """At scale the profile joins exceed any broadcast threshold: with
    broadcasting off the plans use shuffle joins and give the same rows."""
    import __spark_entry__ as E

    names = ["share_expected", "segments_2way", "best_segment", "prior_sensitivity", "dictionary_long", "classify_index"]
    q = E.queries()
    before = {n: sorted(tuple(r) for r in q[n](spark, SF01).collect()) for n in names}
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan = physical(q["share_expected"](spark, SF01))
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        for n in names:
            assert sorted(tuple(r) for r in q[n](spark, SF01).collect()) == before[n], n
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_bounded_broadcast_hint_only_under_bound(spark):
    from plurality.session import bounded_broadcast

    small = spark.range(10)
    big = spark.range(1000)
    hinted = big.join(bounded_broadcast(small, 10, max_bytes=1000), "id")
    unhinted = big.join(bounded_broadcast(small, 10, max_bytes=100), "id")
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in unhinted._jdf.queryExecution().analyzed().toString().lower()


def test_hot_customer_key_same_shares_with_shuffle_joins(spark, monkeypatch):
    """A third of the orders remapped to one customer: the shuffle-join plan
    (broadcast off, AQE skew handling on) gives the same shares."""
    from pyspark.sql import functions as F

    import plurality.sources.profiles as P

    orig = P.table

    def skewed(sp, sf_dir, name, schema=None):
        df = orig(sp, sf_dir, name, schema)
        if name == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("o_custkey")))
        return df

    monkeypatch.setattr(P, "table", skewed)
    rule = S.STANDARD_RULE

    def run():
        return sorted(tuple(r) for r in shares.shares(scoring.probabilities(P.order_profile(spark, SF01), rule), rule).collect())

    base = run()
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert run() == base
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_wide_profile_reads_only_needed_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from plurality.sources.profiles import wide_profile

    cols = [F.concat(F.lit("v"), (F.col("id") % (i + 2)).cast("string")).alias(f"attr{i}") for i in range(40)]
    path = str(tmp_path / "wide")
    spark.range(200).select(F.col("id").cast("string").alias("persona_id"), *cols).write.parquet(path)
    df = wide_profile(spark, path, ["attr3", "attr7"])
    assert df.columns == ["unit_id", "attr3", "attr7"]
    scan = [line for line in physical(df).split("\n") if "ReadSchema" in line or "wide" in line][0]
    assert "attr3" in scan and "attr11" not in scan


def _wide_rule(n):
    """A rule with n segment attributes of four values each, and its catalog and units."""
    from plurality.spec import Catalog, Choice, Factor, Rule

    names = [f"a{i}" for i in range(n)]
    rule = Rule("q", (Choice("x", ""), Choice("y", "")), {"x": 0.5, "y": 0.5}, tuple(Factor(a, ("v1",), {"x": 0.1}) for a in names), (), "ab" * 32)
    return rule, Catalog({a: [f"v{k}" for k in range(4)] for a in names}), names


def test_segments_and_report_have_one_plan_for_every_rule_size(spark, tmp_path):
    """0, 3 and 8 attributes (product of list sizes up to 390,625): one scan of
    the units, partial aggregates only, no single-partition step above them."""
    from pyspark.sql import functions as F

    from plurality.plans.report import rule_report

    path = str(tmp_path / "units")
    spark.range(3000).select(F.col("id").cast("string").alias("unit_id"),
                             *[F.concat(F.lit("v"), (F.hash("id", F.lit(i)) % 5).cast("string")).alias(f"a{i}") for i in range(8)]).write.parquet(path)
    units = spark.read.parquet(path)
    for n in (0, 3, 8):
        rule, catalog, names = _wide_rule(n)
        scored = scoring.probabilities(units, rule)
        plan = physical(shares.cube(scored, rule, catalog, arities=(1, 2)))
        assert plan.count("FileScan parquet") == 1 and "Coalesce" not in plan
        assert "partial_sum" in plan
        segs = shares.segments(scored, rule, catalog, min_abs=1).collect()
        blocks = rule_report(spark, units, rule, catalog)
        assert {k: v.count() for k, v in blocks.items() if k in ("rows", "choices", "missing")} == {"rows": 1, "choices": 2, "missing": 1}
        if not n:
            assert not segs and set(blocks) == {"rows", "choices", "preference_groups", "missing"}
            continue
        pairs = units.groupBy("a0", "a1").count().where("a0 in ('v0','v1','v2','v3') and a1 in ('v0','v1','v2','v3') and count >= 30").count()
        assert sum(r.attr_1 == "a0" and r.attr_2 == "a1" for r in segs) == 2 * pairs


def test_effect_lookup_needs_no_join_or_shuffle_of_units(spark, monkeypatch):
    prof = spark.range(5000).selectExpr("CAST(id AS STRING) AS unit_id", "concat('b', id % 5) AS basket", "concat('p', id % 3) AS priority", "CASE WHEN id % 4 > 0 THEN 's' END AS segment")
    table = spark.createDataFrame([("basket", "b1", 0, 0.5), ("basket", "b1", 2, 0.25), ("priority", "p2", 1, 1.0), ("segment", "s", 0, 0.125), ("segment", "s", 0, 0.125),
                                   ("other", "b1", 0, 9.0)], "attribute string, condition string, slot int, effect double")
    packed = scoring.with_table_effects(prof, table, ["basket", "priority", "segment"], 3)
    main = physical(packed).split("Subquery")[0]
    assert "Join" not in main and "Exchange" not in main and "explode" not in main.lower()
    want = {str(i): [0.5 * (i % 5 == 1) + 0.25 * (i % 4 > 0), 1.0 * (i % 3 == 2), 0.25 * (i % 5 == 1)] for i in range(5000)}
    assert {r.unit_id: r._fit for r in packed.collect()} == want
    # a table too large to be sent whole is joined, with the same result
    monkeypatch.setattr(scoring, "PACKED_EFFECT_BYTES", 0)
    joined = scoring.with_table_effects(prof, table, ["basket", "priority", "segment"], 3)
    assert "Join" in physical(joined) and {r.unit_id: r._fit for r in joined.collect()} == want
    empty = scoring.with_table_effects(prof, table.limit(0), ["basket"], 2)
    assert {tuple(r._fit) for r in empty.collect()} == {(0.0, 0.0)}


def test_subset_decode_does_not_split_the_blobs(spark):
    from plurality.operators.packed import decode_fields, decode_wide
    from plurality.plans.queries import PACKED_FIELDS

    packed = profiles.packed_profile(spark, SF01)
    names = [PACKED_FIELDS[i][0] for i in (0, 3, 9, 31)]
    plan = optimized(decode_fields(packed, PACKED_FIELDS, names[:1]))
    assert "split(" not in plan
    a = sorted(tuple(map(str, r)) for r in decode_fields(packed, PACKED_FIELDS, names).collect())
    b = sorted(tuple(map(str, r)) for r in decode_wide(packed, PACKED_FIELDS, select=names).collect())
    assert a == b
    for short in ("null", "zero"):
        a = sorted(tuple(map(str, r)) for r in decode_fields(packed, PACKED_FIELDS, names, short=short).collect())
        b = sorted(tuple(map(str, r)) for r in decode_wide(packed, PACKED_FIELDS, select=names, short=short).collect())
        assert a == b


def test_hot_join_key_is_split(spark, tmp_path):
    """With thresholds at test size, adaptive execution splits the partition of
    a key that holds a third of the rows."""
    from pyspark.sql import functions as F

    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        orders = profiles.table(spark, SF01, "orders", "o_orderkey BIGINT, o_custkey BIGINT").repartition(8)
        orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("o_custkey")))
        customers = profiles.table(spark, SF01, "customer", "c_custkey BIGINT, c_mktsegment STRING")
        joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        assert len(joined.collect()) > 0
        assert "skew=true" in physical(joined)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
