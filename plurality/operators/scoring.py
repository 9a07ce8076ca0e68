"""Row scoring: logits, softmax, expected and sampled modes.

Every row is scored with literal expressions only, so scoring is a narrow
projection fused into the scan's whole-stage code: no shuffle, no UDF.
The noise hash of a (row, choice) depends on neither factors nor prior, so it
is produced once in its own projection and shared by every scenario built on
top of it (Catalyst keeps a non-cheap producer out of the collapsed project).
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions.hashing import keyed_text, uniform_of_digest
from plurality.spec import DRAW_SUFFIX, NOISE_SCALE, Factor, Rule

KEY = "unit_id"


def noise_col(i: int) -> str:
    return f"_u{i}"


def prob_col(i: int) -> str:
    return f"p{i}"


def effect_terms(factors: Sequence[Factor], choice: str) -> list[Column]:
    """CASE WHEN attr IN (...) THEN effect ELSE 0 END per non-zero effect.
    NULL attributes do not match and add 0."""
    terms = []
    for factor in factors:
        effect = factor.effect(choice)
        if effect:
            terms.append(F.when(F.col(factor.attribute).isin(*factor.conditions), F.lit(effect)).otherwise(F.lit(0.0)))
    return terms


def with_noise(df: DataFrame, seed: str, choices: Sequence[str], key: str = KEY, draw: bool = False,
               draw_suffix: str = DRAW_SUFFIX) -> DataFrame:
    """Adds the uniform hash per choice (and the sampled-mode draw). The draw
    suffix defaults to the reference's; pass e.g. ``'#draw'`` to keep it
    apart from a choice whose id equals it."""
    suffixes = [(noise_col(i), c) for i, c in enumerate(choices)]
    if draw:
        suffixes.append(("_draw", draw_suffix))
    # stage 1: one MD5 per (row, suffix); stage 2: byte reversal and scaling
    digests = df.select("*", *[F.md5(keyed_text(seed, F.col(key), sfx)).alias(f"_d{name}") for name, sfx in suffixes])
    keep = [c for c in df.columns]
    return digests.select(*keep, *[uniform_of_digest(F.col(f"_d{name}")).alias(name) for name, _ in suffixes])


def logit(rule: Rule, choice_index: int, factors: Sequence[Factor] | None = None, log_prior: float | None = None) -> Column:
    """ln(prior) + effects (left to right) + (u - 0.5) * 0.08, on the noise columns."""
    choice = rule.choice_ids[choice_index]
    lp = rule.log_prior(choice) if log_prior is None else log_prior
    terms = [F.lit(lp), *effect_terms(rule.factors if factors is None else factors, choice)]
    noise = (F.col(noise_col(choice_index)) - F.lit(0.5)) * F.lit(NOISE_SCALE)
    return reduce(add, [*terms, noise])


def staged_softmax(df: DataFrame, keep: Sequence[str], groups: Sequence[tuple[Sequence[Column], Sequence[str]]]) -> DataFrame:
    """Softmax over several score groups in four projections (logits, max,
    weights, probabilities). Each stage is referenced more than once by the
    next, so Catalyst keeps them apart and every value is computed once per
    row. ``groups`` = [(score expressions, output names)]. The last three
    stages are plain arithmetic on named columns, written as SQL expressions
    (one call per projection instead of one per column)."""
    keep = list(keep)
    kept = [f"`{c}`" for c in keep]
    logits, maxes, weights, probs = [], [], [], []
    for g, (scores, names) in enumerate(groups):
        s_names = [f"_s{g}_{i}" for i in range(len(scores))]
        logits += [sc.alias(n) for sc, n in zip(scores, s_names)]
        maxes.append((f"greatest({', '.join(s_names)})" if len(s_names) > 1 else s_names[0]) + f" AS _m{g}")
        w_names = [f"_w{g}_{i}" for i in range(len(scores))]
        weights += [f"exp({sn} - _m{g}) AS {wn}" for sn, wn in zip(s_names, w_names)]
        total = " + ".join(w_names)
        probs += [f"{wn} / ({total}) AS `{out}`" for wn, out in zip(w_names, names)]
    a = df.select(*keep, *logits)
    b = a.selectExpr("*", *maxes)
    c = b.selectExpr(*kept, *weights)
    return c.selectExpr(*kept, *probs)


def score(df: DataFrame, rule: Rule, key: str = KEY, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns + s0..s{n-1} logits. Rows with a NULL key are excluded."""
    keep = list(rule.needed_attributes() if keep is None else keep)
    base = df.where(F.col(key).isNotNull()).select(key, *sorted(set(keep) | set(rule.factor_attributes())))
    noisy = with_noise(base, rule.seed, rule.choice_ids, key)
    scores = [logit(rule, i).alias(f"s{i}") for i in range(len(rule.choices))]
    return noisy.select(key, *keep, *scores)


def probabilities(df: DataFrame, rule: Rule, key: str = KEY, keep: Sequence[str] | None = None, mode: str = "expected",
                  draw_suffix: str = DRAW_SUFFIX, null_keys: bool = False) -> DataFrame:
    """``key``, ``keep`` columns and p0..p{n-1}. Rows with a NULL key are left
    out, or with ``null_keys`` kept with NULL probabilities, to be counted.

    expected: softmax probabilities. sampled: one draw per row picks the first
    choice whose cumulative probability exceeds it (the last is the ELSE),
    emitted one-hot as doubles.
    """
    keep = list(rule.needed_attributes() if keep is None else keep)
    n = len(rule.choices)
    if mode not in ("expected", "sampled"):
        raise ValueError(f"unknown mode: {mode}")
    rows = df if null_keys else df.where(F.col(key).isNotNull())
    base = rows.select(key, *sorted(set(keep) | set(rule.factor_attributes())))
    noisy = with_noise(base, rule.seed, rule.choice_ids, key, draw=(mode == "sampled"), draw_suffix=draw_suffix)
    scores = [logit(rule, i) for i in range(n)]
    extra = ["_draw"] if mode == "sampled" else []
    staged = staged_softmax(noisy, [key, *keep, *extra], [(scores, [prob_col(i) if mode == "expected" else f"_q{i}" for i in range(n)])])
    if mode == "expected":
        return staged
    pick = None
    for i in range(n - 1):
        cumulative = reduce(add, [F.col(f"_q{j}") for j in range(i + 1)])
        pick = F.when(F.col("_draw") < cumulative, F.lit(i)) if pick is None else pick.when(F.col("_draw") < cumulative, F.lit(i))
    pick = pick.otherwise(F.lit(n - 1)) if pick is not None else F.lit(0)
    picked = staged.select(key, *keep, pick.alias("_selected"))
    return picked.select(
        key, *keep,
        *[F.when(F.col(key).isNotNull(), F.when(F.col("_selected") == i, F.lit(1.0)).otherwise(F.lit(0.0))).alias(prob_col(i)) for i in range(n)]
    )


#: most bytes of a packed effect table that goes into the tasks whole; a larger one is joined
PACKED_EFFECT_BYTES = 64 << 20


def score_by_join(df: DataFrame, rule: Rule, factor_table: DataFrame, key: str = KEY) -> DataFrame:
    """Data-driven variant of the logits: effects arrive as a table
    ``(attribute, condition, choice_index, effect)``. See ``with_table_effects``."""
    n = len(rule.choices)
    attrs = sorted({f.attribute for f in rule.factors})
    rows = df.where(F.col(key).isNotNull()).select(key, *attrs)
    fitted = with_table_effects(rows, factor_table.withColumn("slot", F.col("choice_index")), attrs, n)
    noisy = with_noise(fitted.select(key, "_fit"), rule.seed, rule.choice_ids, key)
    return noisy.select(
        key,
        *[
            (F.lit(rule.log_prior(c)) + F.get("_fit", i) + (F.col(noise_col(i)) - F.lit(0.5)) * F.lit(NOISE_SCALE)).alias(f"s{i}")
            for i, c in enumerate(rule.choice_ids)
        ],
    )


def packed_effects(factor_table: DataFrame, attrs: Sequence[str], n_slots: int) -> DataFrame:
    """One row: per attribute its values (``_v<i>``) and, at the same place, an
    array of ``n_slots`` effects (``_e<i>``). ``factor_table``: attribute,
    condition, slot, effect; effects of one slot and value are added."""
    per_slot = factor_table.where(F.col("attribute").isin(*attrs)).groupBy("attribute", "condition", "slot").agg(F.sum("effect").alias("effect"))
    slots = F.map_from_entries(F.collect_list(F.struct("slot", "effect")))
    per_value = per_slot.groupBy("attribute", "condition").agg(slots.alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    per_value = per_value.select("attribute", F.struct("condition", filled.alias("e")).alias("s"))
    # a global aggregate, so the row is there for an empty table as well
    row = per_value.agg(*[F.sort_array(F.collect_list(F.when(F.col("attribute") == a, F.col("s")))).alias(f"_s{i}") for i, a in enumerate(attrs)])
    return row.select(*[c for i in range(len(attrs)) for c in (F.transform(f"_s{i}", lambda s: s["condition"]).alias(f"_v{i}"),
                                                               F.transform(f"_s{i}", lambda s: s["e"]).alias(f"_e{i}"))])


def with_table_effects(df: DataFrame, factor_table: DataFrame, attrs: Sequence[str], n_slots: int) -> DataFrame:
    """Adds ``_fit``: per slot (a choice, or a rule's choice) the sum of the
    effects whose (attribute, condition) the row has.

    No join, whatever the number of attributes and rules: the packed table is
    the single row of a scalar subquery; an attribute's value gives the place
    of its effects. Its size is known before it is used (values x slots). Rows
    are never exploded, grouped or shuffled. Beyond PACKED_EFFECT_BYTES the
    effects are joined per attribute by value.
    """
    zero = F.array_repeat(F.lit(0.0), n_slots)
    if not attrs:
        return df.withColumn("_fit", zero)
    n_values = factor_table.select("attribute", "condition").distinct().count()
    if n_values * (8 * n_slots + 64) <= PACKED_EFFECT_BYTES:
        packed = packed_effects(factor_table, attrs, n_slots)
        table = packed.select(F.struct(*packed.columns)).scalar()
        found = {}
        for i, a in enumerate(attrs):
            place = (F.array_position(table[f"_v{i}"], F.col(a).cast("string")) - 1).cast("int")
            found[f"_l{i}"] = F.coalesce(F.get(table[f"_e{i}"], place), zero)
        fit = reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a + b), [F.col(c) for c in found])
        return df.withColumns(found).withColumn("_fit", fit).drop(*found)
    out = df.withColumn("_fit", zero)
    for a in attrs:
        side = packed_effects(factor_table, [a], n_slots).select(F.explode(F.arrays_zip("_v0", "_e0")).alias("z")).select(F.col("z._v0").alias("_value"), F.col("z._e0").alias("_effects"))
        out = out.join(side, F.col(a).cast("string") == F.col("_value"), "left")
        out = out.withColumn("_fit", F.zip_with("_fit", F.coalesce("_effects", zero), lambda x, y: x + y)).drop("_value", "_effects")
    return out


def score_rules(df: DataFrame, rules: Mapping[str, Rule], key: str = KEY) -> DataFrame:
    """Many stored rules over one table: ``rule_id, key, choice_index, choice,
    score`` for every rule and row, effects from the rules' factor table.

    A row's effects for all rules come from one lookup (a slot per rule and
    choice); noise is hashed once per distinct (seed, choice); only then the
    row is spread to its result rows.
    """
    spark = df.sparkSession
    slots = [(rule_id, rule, i, c) for rule_id, rule in rules.items() for i, c in enumerate(rule.choice_ids)]
    table = None
    for rule_id, rule in rules.items():
        own = {i: k for k, (r, _, i, _) in enumerate(slots) if r == rule_id}
        part = factor_table(spark, rule)
        part = part.withColumn("slot", F.get(F.array(*[F.lit(own[i]) for i in range(len(own))]), "choice_index"))
        table = part if table is None else table.unionByName(part)
    attrs = sorted({f.attribute for r in rules.values() for f in r.factors})
    rows = df.where(F.col(key).isNotNull()).select(key, *attrs)
    fitted = with_table_effects(rows, table, attrs, len(slots)).select(key, "_fit")
    hashes = list(dict.fromkeys((rule.seed, c) for _, rule, _, c in slots))
    hashed = fitted.select(key, "_fit", F.array(*[F.md5(keyed_text(seed, F.col(key), c)) for seed, c in hashes]).alias("_d"))
    place = {h: k for k, h in enumerate(hashes)}
    own = F.array(*[F.struct(F.lit(rule_id).alias("rule_id"), F.lit(i).alias("choice_index"), F.lit(c).alias("choice"), F.lit(rule.log_prior(c)).alias("prior"),
                             F.lit(k).alias("slot"), F.lit(place[(rule.seed, c)]).alias("hash")) for k, (rule_id, rule, i, c) in enumerate(slots)])
    long = hashed.withColumn("_own", F.explode(own)).select("_own.*", key, F.get("_fit", F.col("_own.slot")).alias("_fit"), F.get("_d", F.col("_own.hash")).alias("_d"))
    noise = (uniform_of_digest(F.col("_d")) - F.lit(0.5)) * F.lit(NOISE_SCALE)
    return long.select("rule_id", key, "choice_index", "choice", (F.col("prior") + F.col("_fit") + noise).alias("score"))


def factor_table(spark, rule: Rule) -> DataFrame:
    """Rule factors as a long table (one row per attribute, condition, choice).
    Conditions repeated within a factor are counted once."""
    rows = []
    for factor in rule.factors:
        for i, c in enumerate(rule.choice_ids):
            eff = factor.effect(c)
            if eff:
                for cond in dict.fromkeys(factor.conditions):
                    rows.append((factor.attribute, cond, i, float(eff)))
    return spark.createDataFrame(rows, "attribute string, condition string, choice_index int, effect double").coalesce(1)
