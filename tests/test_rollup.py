"""Roll-up of grouping sets over a lattice, and sums that do not depend on partitioning."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plurality.operators import scoring, shares
from plurality.plans import standard as S
from plurality.spec import Catalog, Choice, Factor, Rule


def wide(spark, n_attrs, n_rows=4000, values=4):
    r = random.Random(n_attrs)
    names = [f"a{i}" for i in range(n_attrs)]
    rows = [(str(k) if k % 11 else None, *[r.choice([None, "off", *[f"v{j}" for j in range(values)]]) for _ in names]) for k in range(n_rows)]
    df = spark.createDataFrame(rows, "unit_id string, " + ", ".join(f"{a} string" for a in names))
    catalog = Catalog({a: [f"v{j}" for j in range(values)] for a in names}, breakdowns=("a0", "a1"), non_segment=())
    rule = Rule("q", (Choice("x"), Choice("y")), {"x": 0.6, "y": 0.4}, tuple(Factor(a, ("v0",), {"x": 0.05}) for a in names), ("a0", "a1"), "ab" * 32)
    return df, catalog, rule


@pytest.mark.parametrize("n_attrs", [1, 2, 6, 7, 12])
def test_rolled_up_sets_equal_grouping_sets(spark, n_attrs):
    df, catalog, rule = wide(spark, n_attrs)
    groups = [g for g in rule.result_groups if g in df.columns]
    scored = scoring.probabilities(df, rule, null_keys=True, keep=df.columns[1:])
    keyed = F.col("unit_id").isNotNull()
    cells = shares.cube(scored, rule, catalog, groups, (1, 2), extra=[F.count_if(~keyed).alias("gone")], where=keyed)
    sets = [[], *[[f"_g_{g}"] for g in groups], *[[f"_k_{a}" for a in c] for k in (1, 2) for c in combinations(sorted(df.columns[1:]), k)]]
    keys = [c for c in cells.columns if c.startswith(("_g_", "_k_"))]
    columns = [*[shares.bucket_key(g, catalog) for g in groups], *[shares.valid_value(k[3:], catalog).alias(k) for k in keys if k.startswith("_k_")]]
    parts = {f"s{i}{half}": F.sum(part) for i in range(2) for half, part in zip("hl", shares.fixed_parts(f"p{i}"))}
    want = scored.select("*", *columns).groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("g"), F.count_if(keyed).alias("n"), F.count_if(~keyed).alias("gone"), *[v.alias(k) for k, v in parts.items()])
    total = [shares.fixed_total(F.col(f"s{i}h"), F.col(f"s{i}l")) for i in range(2)]
    want = want.select(*keys, "g", "n", *[t.alias(f"t{i}") for i, t in enumerate(total)], "gone")
    got = cells.select(*keys, "_gid", "n", "_sum_p0", "_sum_p1", "gone")
    # the same rows, sums equal to the last bit
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_rows_are_not_expanded(spark, tmp_path):
    df, catalog, rule = wide(spark, 12)
    df.write.parquet(str(tmp_path / "units"))
    scored = scoring.probabilities(spark.read.parquet(str(tmp_path / "units")), rule)
    cells = shares.cube(scored, rule, catalog, rule.result_groups, (1, 2))
    cells.collect()
    plan = cells._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    # from the scan up: the aggregate by all keys comes before anything that multiplies rows
    below = plan[plan.rindex("HashAggregate"):]
    assert "Expand" not in plan and "Generate" not in below and "FileScan" in below


def test_lattice_covers_every_set_with_few_intermediates():
    for k in range(1, 30):
        keys = [f"k{i}" for i in range(k)]
        sets = [(), *[(a,) for a in keys], *combinations(keys, 2)]
        plan = shares.lattice(keys, sets)
        assert sorted(map(tuple, (s for v in plan.values() for s in v))) == sorted(sets)
        assert all(set(s) <= set(u) for u, v in plan.items() for s in v)
        assert len(plan) <= max(1, (k // 3 + 1) ** 2 / 2)


def test_totals_are_bit_equal_for_every_partitioning(spark):
    from plurality.operators.ensemble import scenario_aggregate

    df, catalog, rule = wide(spark, 3, n_rows=20_000)
    rule = S.STANDARD_RULE
    df = df.select("unit_id", F.col("a0").alias("priority"), F.col("a1").alias("basket"), F.col("a2").alias("segment"), F.col("a2").alias("returned"))
    seen, grids = set(), set()
    for n in (1, 4, 64):
        for order in (F.col("unit_id"), F.desc("unit_id"), F.xxhash64("unit_id")):
            rows = df.repartition(n, F.rand(n)).sortWithinPartitions(order)
            seen.add(tuple(shares.totals(scoring.probabilities(rows, rule, keep=[]), 3).first()))
        grids.add(tuple(scenario_aggregate(df.repartition(n, F.rand(n)), S.STANDARD_ENSEMBLE)[0].first()))
    assert len(seen) == 1 and len(grids) == 1


def test_fixed_sum_is_close_and_exact(spark):
    r = random.Random(1)
    values = [r.random() * 10 ** -r.randint(0, 12) for _ in range(5000)] + [0.0, 1.0, -1.0, 2.0 ** -52]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "p double")
    from fractions import Fraction

    got = df.agg(shares.fixed_sum("p").alias("s")).first().s
    want = sum(round(Fraction(v) * 2**52) for v in values)
    assert abs(got - sum(values)) < 1e-11 and abs(got * 2**52 - want) <= abs(want) * 2**-52
    assert df.limit(0).agg(shares.fixed_sum("p").alias("s")).first().s is None
