"""Aggregations of row probabilities.

All results are tiny (a few rows per choice, group or segment); the work is
the partial aggregation over the scored rows, which runs before any shuffle,
so a key holding a third of all rows costs no more than any other key.

Sums are taken in fixed point (``fixed_sum``), so they do not depend on how the
rows are partitioned, and a coarse sum is the exact sum of finer ones. ``cube``
uses that: rows are aggregated once, by all keys, and every grouping set is
rolled up from those cells, over a lattice of a few intermediate sets.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.functions.sqltext import sql_string
from plurality.operators.scoring import prob_col
from plurality.session import bounded_broadcast
from plurality.spec import Catalog, Factor, Rule

UNKNOWN = "Unknown"


#: fixed point: multiples of 2^-FRACTION, summed in a high part and LOW low bits
FRACTION, LOW = 52, 26


def fixed_parts(value: Column | str) -> tuple[Column, Column]:
    """High and low integer part of a value in [-1, 1] or so; partial sums of each stay exact up to 2^37 rows."""
    v = F.rint((F.col(value) if isinstance(value, str) else value) * F.lit(float(1 << FRACTION))).cast("bigint")
    return F.shiftright(v, LOW), v.bitwiseAND(F.lit((1 << LOW) - 1))


def fixed_total(high: Column, low: Column) -> Column:
    """The double of summed parts."""
    return (high.cast("double") * F.lit(float(1 << LOW)) + low.cast("double")) / F.lit(float(1 << FRACTION))


def fixed_sum(value: Column | str) -> Column:
    """Sum of probabilities (or other values in [-1, 1]), bit-equal for every order and partitioning of the rows."""
    high, low = fixed_parts(value)
    return fixed_total(F.sum(high), F.sum(low))


def pct(part: Column, whole: Column) -> Column:
    """part * 100 / whole; NULL on an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole.cast("double"))


def long_by_choice(df: DataFrame, choices: Sequence[str], value_prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide ``{prefix}{i}`` columns to rows ``(choice_index, choice, total)``
    with ``stack``."""
    rows = ", ".join(f"{i}, {sql_string(c)}, `{value_prefix}{i}`" for i, c in enumerate(choices))
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(choices)}, {rows}) AS (choice_index, choice, total)")


def totals(scored: DataFrame, n_choices: int) -> DataFrame:
    """One row: n and t0..t{n-1} = sum of p_i. Partial + final aggregate."""
    return scored.agg(F.count(F.lit(1)).alias("n"), *[fixed_sum(prob_col(i)).alias(f"t{i}") for i in range(n_choices)])


def shares(scored: DataFrame, rule: Rule, digits: int = 6) -> DataFrame:
    """Overall share per choice: ``choice_index, choice, n, total, percent``."""
    t = totals(scored, len(rule.choices))
    long = long_by_choice(t, rule.choice_ids, "t", keep=["n"])
    return long.select(
        "choice_index",
        "choice",
        "n",
        F.round("total", digits).alias("total"),
        F.round(pct(F.col("total"), F.col("n")), digits).alias("percent"),
    )


def first_max_index(values: Sequence[Column]) -> Column:
    """Index of the first maximum of the given columns (ties -> earliest)."""
    expr = None
    for i, v in enumerate(values):
        cond = reduce(lambda a, b: a & b, [v > w for w in values[:i]] + [v >= w for w in values[i + 1:]], F.lit(True))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(0))


def apportion(wide: DataFrame, n_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Integer counts: each value rounded half-even; ``n - sum`` is added to
    the first largest count. Row-wise expressions, no window."""
    rounded = [F.rint(F.col(c)).cast("bigint") for c in value_cols]
    staged = wide.select("*", *[r.alias(f"_r{i}") for i, r in enumerate(rounded)])
    rs = [F.col(f"_r{i}") for i in range(len(value_cols))]
    residual = F.col(n_col) - reduce(add, rs)
    winner = first_max_index(rs)
    return staged.select(
        "*", *[(F.col(f"_r{i}") + F.when(winner == i, residual).otherwise(F.lit(0))).alias(f"count{i}") for i in range(len(value_cols))]
    )


def apportioned_counts(scored: DataFrame, rule: Rule, digits: int = 6) -> DataFrame:
    """``choice_index, choice, n, count, percent`` with counts summing to n."""
    return counted_rows(totals(scored, len(rule.choices)), rule, digits)


def counted_rows(t: DataFrame, rule: Rule, digits: int = 6) -> DataFrame:
    """``apportioned_counts`` from a row of totals (n, t0, t1, ...)."""
    counted = apportion(t, "n", [f"t{i}" for i in range(len(rule.choices))])
    items = [
        F.struct(
            F.lit(i).alias("choice_index"),
            F.lit(c).alias("choice"),
            F.col(f"count{i}").alias("count"),
            F.round(pct(F.col(f"t{i}"), F.col("n")), digits).alias("percent"),
        )
        for i, c in enumerate(rule.choice_ids)
    ]
    return counted.select("n", F.inline(F.array(*items)))


def grouping_bits(all_cols: Sequence[str], grouped: Sequence[str]) -> int:
    """Value of grouping_id() for a grouping set (first column = top bit)."""
    k = len(all_cols)
    return sum(1 << (k - 1 - i) for i, c in enumerate(all_cols) if c not in grouped)


def cube_sets(rule: Rule, catalog: Catalog, groups: Sequence[str] = (), arities: Sequence[int] = ()) -> list[tuple[str, ...]]:
    """Grouping sets of a report: the total, one per breakdown column and the
    1- and 2-way combinations of the segment attributes."""
    attrs = segment_attributes(rule, catalog) if arities else []
    return [(), *[(f"_g_{g}",) for g in groups], *[c for k in arities for c in combinations(attrs, k)]]


def cube(scored: DataFrame, rule: Rule, catalog: Catalog, groups: Sequence[str] = (), arities: Sequence[int] = (),
         sums: Sequence[str] | None = None, extra: Sequence[Column] = (), where: Column | None = None) -> DataFrame:
    """All grouping sets of a report: keys, ``_gid``, ``n`` and the sums.

    The rows are aggregated once, by all keys together (no Expand over rows);
    there are never more such cells than rows. All sets are rolled up from the
    cells (``roll_up``). Breakdown keys map off-list values to Unknown, segment
    keys map them to NULL. ``sums``: the summed columns (default: the choice
    probabilities); ``extra``: counts over the rows (their value in the total
    set is the global one); ``where``: the rows that ``n`` counts.
    """
    sums = [prob_col(i) for i in range(len(rule.choices))] if sums is None else list(sums)
    sets = cube_sets(rule, catalog, groups, arities)
    keys = list(dict.fromkeys(k for s in sets for k in s))
    columns = [*[bucket_key(g, catalog) for g in groups], *[valid_value(k, catalog).alias(f"_k_{k}") for k in keys if not k.startswith("_g_")]]
    named = [k if k.startswith("_g_") else f"_k_{k}" for k in keys]
    rename = dict(zip(keys, named))
    size = F.count(F.lit(1)) if where is None else F.count_if(where)
    parts = [F.sum(part).alias(f"_{half}_{c}") for c in sums for half, part in zip(("high", "low"), fixed_parts(c))]
    rows = scored.select("*", *columns)
    cells = rows.groupBy(*named).agg(size.alias("n"), *parts, *extra)
    cells = roll_up(cells, named, [[rename[k] for k in s] for s in sets]) if keys else cells.withColumn("_gid", F.lit(0).cast("bigint"))
    counts = [c for c in cells.columns if c not in {*named, "_gid", "n", *[f"_{half}_{c}" for c in sums for half in ("high", "low")]}]
    return cells.select(*named, "_gid", "n", *[fixed_total(F.col(f"_high_{c}"), F.col(f"_low_{c}")).alias(f"_sum_{c}") for c in sums], *counts)


#: keys of a block of the lattice; intermediate sets are unions of two blocks
LATTICE_BLOCK = 3


def lattice(keys: Sequence[str], sets: Sequence[Sequence[str]]) -> dict[tuple[str, ...], list[Sequence[str]]]:
    """Intermediate grouping sets, each with the final ones that are derived from it.

    Every pair of keys lies in the union of two blocks, so k keys need about
    (k / LATTICE_BLOCK)^2 / 2 intermediate sets instead of k^2 / 2 final ones.
    """
    blocks = [tuple(keys[i : i + LATTICE_BLOCK]) for i in range(0, len(keys), LATTICE_BLOCK)]
    unions = [a + b for a, b in combinations(blocks, 2)] if len(blocks) > 2 and all(len(s) <= 2 for s in sets) else [tuple(keys)]
    plan: dict[tuple[str, ...], list[Sequence[str]]] = {}
    for s in sets:
        plan.setdefault(next(u for u in unions if set(s) <= set(u)), []).append(s)
    return plan


def roll_up(cells: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """The grouping sets ``sets`` (with ``_gid``) of sums that were taken by all ``keys``.

    First the intermediate sets of ``lattice``, then the final ones, each from
    the one that covers it; both steps combine before they shuffle.
    """
    plan = lattice(keys, sets)
    bits = {u: grouping_bits(keys, u) for u in plan}
    if list(plan) == [tuple(keys)]:
        return _regroup(cells, keys, _masks([grouping_bits(keys, s) for s in sets]))
    between = _regroup(cells, keys, _masks(list(bits.values())))
    targets = None
    for u, finals in plan.items():
        here = _masks([grouping_bits(keys, s) for s in finals])
        targets = F.when(F.col("_gid") == bits[u], here) if targets is None else targets.when(F.col("_gid") == bits[u], here)
    return _regroup(between, keys, targets)


def _masks(bits: Sequence[int]) -> Column:
    return F.array(*[F.lit(b).cast("bigint") for b in bits])


def _regroup(cells: DataFrame, keys: Sequence[str], masks: Column) -> DataFrame:
    """Sums by each of ``masks`` (one bit per key that is left out, the first key's on top)."""
    values = [c for c in cells.columns if c not in {*keys, "_gid"}]
    spread = cells.select(*keys, *values, F.explode(masks).alias("_gid"))
    left_out = [F.col("_gid").bitwiseAND(F.lit(1 << (len(keys) - 1 - i)).cast("bigint")) != 0 for i in range(len(keys))]
    kept = [F.when(~out, F.col(k)).alias(k) for k, out in zip(keys, left_out)]
    return spread.select(*kept, "_gid", *values).groupBy("_gid", *keys).agg(*[F.sum(v).alias(v) for v in values])


def cube_bits(cells: DataFrame, grouped: Sequence[str]) -> int:
    """``_gid`` of a grouping set of a ``cube``."""
    return grouping_bits([c for c in cells.columns if c.startswith(("_g_", "_k_"))], grouped)


def cube_total(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("_gid") == cube_bits(cells, []))


def breakdown(scored: DataFrame | None, rule: Rule, catalog: Catalog, groups: Sequence[str] | None = None, digits: int = 6,
              cells: DataFrame | None = None) -> DataFrame:
    """Per result group: off-list or NULL values go to ``Unknown``; one
    pass covers all groups. No groups, no rows.

    Output ``group_attribute, group_value, n, choice_index, choice, percent``.
    ``cells``: a ``cube`` that holds the groups."""
    groups = list(rule.result_groups if groups is None else groups)
    n = len(rule.choices)
    cells = cube(scored, rule, catalog, groups) if cells is None else cells
    attr = value = F.lit(None).cast("string")
    for g in groups:
        hit = F.col("_gid") == cube_bits(cells, [f"_g_{g}"])
        attr, value = F.when(hit, F.lit(g)).otherwise(attr), F.when(hit, F.col(f"_g_{g}")).otherwise(value)
    named = cells.select(attr.alias("group_attribute"), value.alias("group_value"), "n", *[F.col(f"_sum_{prob_col(i)}").alias(f"t{i}") for i in range(n)])
    named = named.where(F.col("group_attribute").isNotNull() & (F.col("n") > 0))
    long = long_by_choice(named, rule.choice_ids, "t", keep=["group_attribute", "group_value", "n"])
    return long.select(
        "group_attribute", "group_value", "n", "choice_index", "choice", F.round(pct(F.col("total"), F.col("n")), digits).alias("percent")
    )


def bucket_key(group: str, catalog: Catalog) -> Column:
    """Breakdown key: the value when it is on the catalog list, else Unknown."""
    return F.when(F.col(group).isin(*catalog.values(group)), F.col(group)).otherwise(F.lit(UNKNOWN)).alias(f"_g_{group}")


def valid_value(attribute: str, catalog: Catalog) -> Column:
    """Segment value: on-list values only (off-list and NULL become NULL)."""
    return F.when(F.col(attribute).isin(*catalog.values(attribute)), F.col(attribute)).alias(attribute)


def segment_attributes(rule: Rule, catalog: Catalog) -> list[str]:
    return sorted({f.attribute for f in rule.factors if catalog.is_segment(f.attribute)})


def segments(
    scored: DataFrame | None,
    rule: Rule,
    catalog: Catalog,
    min_abs: int = 1000,
    min_divisor: int = 100,
    digits: int = 6,
    arities: Sequence[int] = (1, 2),
    cells: DataFrame | None = None,
    sums: Sequence[str] | None = None,
) -> DataFrame:
    """1- and/or 2-way segments over the rule's segment attributes.

    A segment qualifies when every grouped attribute holds a catalog value and
    its size is at least ``max(min_abs, n div min_divisor)``. Output
    ``arity, attr_1, value_1, attr_2, value_2, n, choice_index, choice,
    percent, lift_pp`` where lift is percentage points over the overall share.

    One aggregate over the rows, then the roll-up of ``cube``: one plan for
    every number of attributes.
    ``cells``: a ``cube`` with these arities; ``sums``: its summed columns.
    """
    sums = [prob_col(i) for i in range(len(rule.choices))] if sums is None else list(sums)
    cells = cube(scored, rule, catalog, arities=arities, sums=sums) if cells is None else cells
    null = F.lit(None).cast("string")
    arity, labels = F.lit(0), [null] * 4
    for combo in cube_sets(rule, catalog, arities=arities)[1:]:
        hit = F.col("_gid") == cube_bits(cells, [f"_k_{a}" for a in combo])
        arity = F.when(hit, F.lit(len(combo))).otherwise(arity)
        now = [x for a in combo for x in (F.lit(a), F.col(f"_k_{a}"))]
        labels = [F.when(hit, new).otherwise(old) for new, old in zip(now, labels)] + labels[len(now):]
    named = cells.select(
        (F.col("_gid") == cube_bits(cells, [])).alias("_is_total"), arity.alias("arity"),
        *[x.alias(c) for x, c in zip(labels, ("attr_1", "value_1", "attr_2", "value_2"))],
        "n", *[F.col(f"_sum_{c}").alias(f"t{i}") for i, c in enumerate(sums)],
    ).where(F.col("_is_total") | (F.col("arity") > 0))
    long = long_by_choice(named, rule.choice_ids, "t", keep=["_is_total", "arity", "attr_1", "value_1", "attr_2", "value_2", "n"])
    overall = long.where("_is_total").select(
        "choice_index", F.col("n").alias("_n_all"), F.col("total").alias("_t_all")
    )
    # the overall row per choice: at most one row per choice, broadcast
    seg = long.where(~F.col("_is_total")).join(bounded_broadcast(overall, len(sums)), "choice_index")
    threshold = F.greatest(F.lit(min_abs).cast("bigint"), F.floor(F.col("_n_all") / F.lit(min_divisor)).cast("bigint"))
    qualified = seg.where(
        F.col("value_1").isNotNull() & ((F.col("arity") == 1) | F.col("value_2").isNotNull()) & (F.col("n") >= threshold)
    )
    seg_pct = pct(F.col("total"), F.col("n"))
    all_pct = pct(F.col("_t_all"), F.col("_n_all"))
    return qualified.select(
        "arity", "attr_1", "value_1", "attr_2", "value_2", "n", "choice_index", "choice",
        F.round(seg_pct, digits).alias("percent"),
        F.round(seg_pct - all_pct, digits).alias("lift_pp"),
    )


def choices_frame(spark: SparkSession, rule: Rule) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(rule.choice_ids)], "choice_index int, choice string").coalesce(1)


def best_segments(spark: SparkSession, segs: DataFrame, rule: Rule) -> DataFrame:
    """Per choice the segment with the largest (rounded) lift, then size, then
    arity/attributes/values for a total order; NULL when none qualifies."""
    w = Window.partitionBy("choice_index").orderBy(
        F.desc("lift_pp"), F.desc("n"), "arity", "attr_1", "value_1", F.asc_nulls_first("attr_2"), F.asc_nulls_first("value_2")
    )
    top = segs.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk", "choice")
    return bounded_broadcast(choices_frame(spark, rule), len(rule.choices)).join(top, "choice_index", "left").select(
        "choice_index", "choice", "arity", "attr_1", "value_1", "attr_2", "value_2", "n", "percent", "lift_pp"
    )


def missing_cells(scored: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``n_units`` and the number of NULL cells over the distinct attributes."""
    attrs = sorted(set(attributes))
    nulls = [F.count_if(F.col(a).isNull()) for a in attrs]
    total = reduce(add, nulls) if nulls else F.lit(0).cast("bigint")
    return scored.agg(F.count(F.lit(1)).alias("n_units"), total.alias("missing_cells"))


def row_counts(df: DataFrame, key: str = "unit_id") -> DataFrame:
    """``n_rows, n_scored, n_null_key``: rows with a NULL key are not scored; this says how many there are."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(key).alias("n_scored"), F.count_if(F.col(key).isNull()).alias("n_null_key"))


def shares_with_counts(scored: DataFrame, rule: Rule, key: str = "unit_id", digits: int = 6) -> DataFrame:
    """``shares`` with the row counts of the same pass. ``scored``: ``probabilities(..., null_keys=True)``, whose NULL-key rows have no probabilities."""
    t = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count(key).alias("n_scored"), F.count_if(F.col(key).isNull()).alias("n_null_key"),
                   *[fixed_sum(prob_col(i)).alias(f"t{i}") for i in range(len(rule.choices))])
    long = long_by_choice(t, rule.choice_ids, "t", keep=["n_rows", "n_scored", "n_null_key"])
    return long.select("n_rows", "n_scored", "n_null_key", "choice_index", "choice", F.round("total", digits).alias("total"),
                       F.round(pct(F.col("total"), F.col("n_scored")), digits).alias("percent"))


def factor_effects(spark: SparkSession, factors: Sequence[tuple[str, int, Factor]], choices: Sequence[str]) -> DataFrame:
    """Rule factors as rows ``owner, factor_position, attribute, conditions, choice_index, choice, effect`` (effect 0 where absent)."""
    rows = [(owner, pos, f.attribute, "|".join(f.conditions), "|".join(sorted(set(f.conditions))), i, c, float(f.effect(c)))
            for owner, pos, f in factors for i, c in enumerate(choices)]
    schema = ("owner string, factor_position int, attribute string, conditions string, condition_set string, "
              "choice_index int, choice string, effect double")
    return spark.createDataFrame(rows, schema).coalesce(1)


def top_factors(effects: DataFrame, k: int = 3) -> DataFrame:
    """``rank, factor_position, attribute, conditions, max_abs_effect`` of the k strongest factors; ties in rule order. Rule-sized input."""
    strength = effects.groupBy("factor_position", "attribute", "conditions").agg(F.max(F.abs("effect")).alias("max_abs_effect"))
    rank = F.row_number().over(Window.orderBy(F.desc("max_abs_effect"), "factor_position"))
    return strength.withColumn("rank", rank).where(F.col("rank") <= k).select("rank", "factor_position", "attribute", "conditions", "max_abs_effect")
