"""Rule audit as a Spark job (A1-A11, E13, plus an observed-value check).

Rules and ensembles are flat tables (choices, priors, factors, conditions,
effects, groups, perspectives, direct-evidence attributes); every check is a
group-by, an anti/semi join against the catalog, or a filter. Rules given as
configuration are flattened on the driver (``flatten``). Stored rules are rows of
nested columns (``audit_stored``): a rule whose id occurs once has all its checks
as expressions over its own row, without a shuffle (``row_findings``); rules
whose id is repeated or NULL are flattened (``rule_tables``) and take the joins.
One check reads the data: condition values that never occur in the profile.
Output ``rule_id, check, detail``.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators.names import closest
from plurality.session import BROADCAST_MAX_BYTES, bounded_broadcast, row_bytes, scratch_path
from plurality.spec import DRAW_SUFFIX, MAX_ABS_EFFECT, PRIOR_SUM_TOLERANCE, Catalog, Ensemble, Rule

MAX_FACTORS = 12
MAX_GROUPS = 3
#: places a lookup table that is not small is dealt to, for keys that are in most rows
SALTS = 64
#: rows of a scratch file; rules take little room and much work, so that tasks are dealt by files, not bytes
FILE_ROWS = 50_000


def flatten(rules: Mapping[str, Rule | Ensemble]) -> dict[str, list[tuple]]:
    """Driver-side flattening of rule configuration into table rows."""
    t: dict[str, list[tuple]] = {k: [] for k in
                                  ("meta", "choices", "priors", "factors", "conditions", "effects", "groups", "perspectives", "direct", "hybrid_priors",
                                   "selectors", "selector_values")}
    for rid, r in rules.items():
        is_ens = isinstance(r, Ensemble)
        t["meta"].append((rid, "ensemble" if is_ens else "rule",
                          getattr(r, "central_prior_id", None), getattr(r, "fit_only_prior_id", None),
                          is_ens and r.has_hybrid, len(getattr(r, "interactions", ()) or ()),
                          getattr(r, "evidence", None) is not None))
        for pos, c in enumerate(r.choices):
            t["choices"].append((rid, pos, c.id))
        for cid, v in r.base_scores.items():
            t["priors"].append((rid, "authored", "", cid, float(v)))
        for g in r.result_groups:
            t["groups"].append((rid, g))
        sets = [(p.id, p.factors) for p in r.perspectives] if is_ens else [("", r.factors)]
        if is_ens:
            for pos, p in enumerate(r.perspectives):
                t["perspectives"].append((rid, pos, p.id))
            for pos, p in enumerate(r.priors):
                t["hybrid_priors"].append((rid, pos, p.id))
                for cid, v in p.base_scores.items():
                    t["priors"].append((rid, "hybrid", p.id, cid, float(v)))
            for a in r.excluded_direct_attributes:
                t["direct"].append((rid, a, "excluded"))
            if r.evidence is not None:
                for cid, sels in r.evidence.selectors.items():
                    for pos, s in enumerate(sels):
                        t["direct"].append((rid, s.attribute, "evidence"))
                        t["selectors"].append((rid, cid, pos, s.attribute, len(s.conditions)))
                        for cond in s.conditions:
                            t["selector_values"].append((rid, cid, pos, s.attribute, cond))
        for pid, factors in sets:
            for fpos, f in enumerate(factors):
                t["factors"].append((rid, pid, fpos, f.attribute, len(f.conditions), len(f.effects)))
                for cond in f.conditions:
                    t["conditions"].append((rid, pid, fpos, f.attribute, cond))
                for cid, v in f.effects.items():
                    t["effects"].append((rid, pid, fpos, f.attribute, cid, float(v)))
    return t


SCHEMAS = {
    "meta": ("rule_id string, kind string, central_prior_id string, fit_only_prior_id string, hybrid boolean, "
             "n_interactions int, empirical boolean"),
    "choices": "rule_id string, pos int, choice_id string",
    "hybrid_priors": "rule_id string, pos int, prior_id string",
    "priors": "rule_id string, role string, prior_id string, choice_id string, value double",
    "factors": "rule_id string, perspective_id string, factor_pos int, attribute string, n_conditions int, n_effects int",
    "conditions": "rule_id string, perspective_id string, factor_pos int, attribute string, condition string",
    "effects": "rule_id string, perspective_id string, factor_pos int, attribute string, choice_id string, effect double",
    "groups": "rule_id string, grp string",
    "perspectives": "rule_id string, pos int, perspective_id string",
    "direct": "rule_id string, attribute string, role string",
    "selectors": "rule_id string, choice_id string, pos int, attribute string, n_conditions int",
    "selector_values": "rule_id string, choice_id string, pos int, attribute string, condition string",
}


_FACTORS = "array<struct<attribute:string,conditions:array<string>,effects:map<string,double>>>"
#: a stored rule or ensemble; what a kind does not have is NULL or empty
STORED_RULE = (f"rule_id string, kind string, choices array<string>, base_scores map<string,double>, factors {_FACTORS}, "
               "result_groups array<string>, n_interactions int, "
               f"perspectives array<struct<id:string,factors:{_FACTORS}>>, priors array<struct<id:string,base_scores:map<string,double>>>, hybrid boolean, "
               "central_prior_id string, fit_only_prior_id string, excluded array<string>, "
               "evidence map<string,array<struct<attribute:string,conditions:array<string>>>>")


def rule_tables(stored: DataFrame) -> dict[str, DataFrame]:
    """The tables of SCHEMAS from stored rules (STORED_RULE); projections only, no shuffle."""
    lit = F.lit
    sets = stored.select("rule_id", F.explode(F.when(F.col("kind") == "ensemble", F.transform("perspectives", lambda p: F.struct(p["id"].alias("id"), p["factors"].alias("factors"))))
                                              .otherwise(F.array(F.struct(lit("").alias("id"), F.col("factors").alias("factors"))))).alias("s"))
    factors = sets.select("rule_id", F.col("s.id").alias("perspective_id"), F.posexplode("s.factors").alias("factor_pos", "f"))
    own = ["rule_id", "perspective_id", "factor_pos", F.col("f.attribute").alias("attribute")]
    hybrid = stored.where(F.col("kind") == "ensemble").select("rule_id", F.posexplode("priors").alias("pos", "p"))
    authored = stored.select("rule_id", lit("authored").alias("role"), lit("").alias("prior_id"), F.explode("base_scores").alias("choice_id", "value"))
    given = hybrid.select("rule_id", lit("hybrid").alias("role"), F.col("p.id").alias("prior_id"), F.explode("p.base_scores").alias("choice_id", "value"))
    chosen = stored.select("rule_id", F.explode("evidence").alias("choice_id", "sels")).select("rule_id", "choice_id", F.posexplode("sels").alias("pos", "s"))
    excluded = stored.select("rule_id", F.explode("excluded").alias("attribute"), lit("excluded").alias("role"))
    size = lambda c: F.coalesce(F.size(c), lit(0))
    tables = {
        "meta": stored.select("rule_id", "kind", "central_prior_id", "fit_only_prior_id", F.coalesce("hybrid", lit(False)).alias("hybrid"),
                              F.coalesce("n_interactions", lit(0)).alias("n_interactions"), F.col("evidence").isNotNull().alias("empirical")),
        "choices": stored.select("rule_id", F.posexplode("choices").alias("pos", "choice_id")),
        "hybrid_priors": hybrid.select("rule_id", "pos", F.col("p.id").alias("prior_id")),
        "priors": authored.unionByName(given),
        "factors": factors.select(*own, size("f.conditions").alias("n_conditions"), size("f.effects").alias("n_effects")),
        "conditions": factors.select(*own, F.explode("f.conditions").alias("condition")),
        "effects": factors.select(*own, F.explode("f.effects").alias("choice_id", "effect")),
        "groups": stored.select("rule_id", F.explode("result_groups").alias("grp")),
        "perspectives": stored.where(F.col("kind") == "ensemble").select("rule_id", F.posexplode("perspectives").alias("pos", "p")).select(
            "rule_id", "pos", F.col("p.id").alias("perspective_id")),
        "direct": excluded.unionByName(chosen.select("rule_id", F.col("s.attribute").alias("attribute"), lit("evidence").alias("role"))),
        "selectors": chosen.select("rule_id", "choice_id", "pos", F.col("s.attribute").alias("attribute"), size("s.conditions").alias("n_conditions")),
        "selector_values": chosen.select("rule_id", "choice_id", "pos", F.col("s.attribute").alias("attribute"), F.explode("s.conditions").alias("condition")),
    }
    assert set(tables) == set(SCHEMAS)
    return tables


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, f"rules-{name}")
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str, n: int | None = None) -> DataFrame:
    """``rows`` joined to a lookup table on ``keys``, of which a few may be in most rows. ``n``: the table's row count, if known;
    a table that is not small is dealt to SALTS places each, so that no key's rows meet in one task."""
    keys = list(keys)
    if n is not None and n * row_bytes(table.schema) <= BROADCAST_MAX_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def _looked_at(catalog: Catalog, profile: DataFrame | None, used: Sequence[str] | None = None) -> list[str]:
    """Attributes whose values are looked up in the profile."""
    return sorted(set(catalog.attributes) & set(profile.columns) & set(catalog.attributes if used is None else used)) if profile is not None else []


def _observed(profile: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """``attribute, condition``: the values of the profile, each once; only the given attributes are unpivoted."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("condition")) for a in attrs])
    seen = profile.select(F.explode(pairs).alias("kv")).select("kv.attribute", "kv.condition").where(F.col("condition").isNotNull())
    return seen.groupBy("attribute", "condition").count().select("attribute", "condition")


def _known(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return bounded_broadcast(spark.createDataFrame([(a,) for a in catalog.attributes], "attribute string"), len(catalog.attributes))


def _suggested(factors: DataFrame, known: DataFrame) -> DataFrame:
    """``attribute, known``: the closest known name of each unknown attribute that has one."""
    unknown = factors.join(known, "attribute", "left_anti").select(F.col("attribute").alias("unknown"))
    return closest(unknown, known.withColumnRenamed("attribute", "known")).select(F.col("unknown").alias("attribute"), "known")


def audit_stored(spark: SparkSession, stored: DataFrame, catalog: Catalog, profile: DataFrame | None = None, sensitive_pattern: str | None = None) -> DataFrame:
    """Findings of stored rules. The rules are written once in the shared folder; the checks of a rule whose id occurs once need
    only its row and the two lookup tables (observed values, suggested names), those of repeated ids need the flat tables."""
    stored = _written(spark, stored, "stored")
    repeated = _written(spark, stored.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR rule_id IS NULL").select("rule_id"), "repeated")
    attrs = _looked_at(catalog, profile)
    seen = _written(spark, _observed(profile, attrs), "seen") if attrs else None
    near = _written(spark, _suggested(rule_tables(stored)["factors"].select("attribute"), _known(spark, catalog)), "near")
    n_repeated = repeated.count()
    if not n_repeated:
        return row_findings(stored, catalog, near, attrs, seen, sensitive_pattern)
    again = bounded_broadcast(repeated.select(F.col("rule_id").alias("_id")), n_repeated)
    once = stored.where("rule_id IS NOT NULL").join(again, F.col("rule_id") == F.col("_id"), "left_anti")
    several = stored.join(again, F.col("rule_id").eqNullSafe(F.col("_id")), "left_semi")
    flat = {name: _written(spark, table, name) for name, table in rule_tables(_written(spark, several, "several")).items()}
    return row_findings(once, catalog, near, attrs, seen, sensitive_pattern).unionByName(
        audit_tables(spark, flat, catalog, profile, sensitive_pattern, seen=seen))


_HITS = "array<struct<check:string,detail:string,attribute:string,condition:string>>"


def row_findings(stored: DataFrame, catalog: Catalog, near: DataFrame, attrs: Sequence[str], seen: DataFrame | None,
                 sensitive_pattern: str | None = None) -> DataFrame:
    """Findings of stored rules (STORED_RULE) whose ids are not NULL and occur once: the checks of ``audit_tables`` over a rule's
    own row. ``near``: suggested names; ``seen``: observed values of the attributes ``attrs``."""
    col, lit, size = F.col, F.lit, F.size
    lo, hi = PRIOR_SUM_TOLERANCE
    ensemble, no = col("kind") == "ensemble", F.lit(False)

    def among(values: Sequence[str]):
        return lambda x: F.coalesce(x.isin(*values), no)

    def within(array: Column, x: Column) -> Column:
        return F.coalesce(F.array_contains(array, x), no)

    def each(array: Column, f) -> Column:
        """The values of ``f`` for all elements; NULL arrays have none."""
        return F.flatten(F.array_compact(F.transform(array, f)))

    def twice(array: Column) -> Column:
        distinct = F.array_distinct(array)
        return F.when(size(distinct) < size(array), F.filter(distinct, lambda x: size(F.filter(array, lambda y: y.eqNullSafe(x))) > 1))

    def pair(attribute: Column, value: Column) -> Column:
        return F.concat(F.length(attribute).cast("string"), lit(":"), attribute, value)

    def total(values: Column) -> Column:
        return F.aggregate(F.array_compact(values), lit(0.0), lambda s, v: s + v)

    def hit(check: str, detail: Column, attribute: Column | None = None, condition: Column | None = None) -> Column:
        none = lit(None).cast("string")
        return F.struct(lit(check).alias("check"), detail.cast("string").alias("detail"), (none if attribute is None else attribute).alias("attribute"),
                        (none if condition is None else condition).alias("condition"))

    known, breakdown = among(list(catalog.attributes)), among(list(catalog.breakdowns))
    listed = among([f"{len(a)}:{a}{v}" for a, vs in catalog.attributes.items() for v in vs])
    looked_at = among(list(attrs))
    hits: list[Column] = []

    def one(check: str, when: Column, detail: Column) -> None:
        hits.append(F.when(when, F.array(hit(check, detail))))

    def many(check: str, array: Column, detail) -> None:
        hits.append(F.transform(array, lambda x: hit(check, detail(x))))

    # the rule's rows of each table, every array worked out once
    no_rows = lambda c: F.coalesce(c, F.array())
    factor = lambda view, f: F.struct(view.alias("perspective_id"), f["attribute"].alias("attribute"), f["conditions"].alias("conditions"),
                                      f["effects"].alias("effects"), known(f["attribute"]).alias("known"))
    used = F.when(ensemble, each(col("perspectives"), lambda p: F.transform(p["factors"], lambda f: factor(p["id"], f)))).otherwise(
        F.transform("factors", lambda f: factor(lit(""), f)))
    entry = lambda f: F.transform(F.map_entries(f["effects"]), lambda e: F.struct(f["attribute"].alias("attribute"), e["key"].alias("choice_id"), e["value"].alias("effect")))
    value = lambda f: F.transform(f["conditions"], lambda c: F.struct(f["attribute"].alias("attribute"), c.alias("condition"), f["known"].alias("known")))
    given = F.when(ensemble & col("hybrid"), each(col("priors"), lambda p: F.transform(
        F.map_entries(p["base_scores"]), lambda e: F.struct(p["id"].alias("prior_id"), e["key"].alias("choice_id"), e["value"].alias("value")))))
    chosen = each(F.map_entries("evidence"), lambda e: F.transform(e["value"], lambda s: F.struct(
        e["key"].alias("choice_id"), s["attribute"].alias("attribute"), s["conditions"].alias("conditions"), known(s["attribute"]).alias("known"))))
    count = lambda c: F.coalesce(size(c), lit(0))
    rows = stored.select(
        "rule_id", no_rows(col("choices")).alias("choices"), no_rows(F.map_keys("base_scores")).alias("keys"), no_rows(F.map_values("base_scores")).alias("scores"),
        no_rows(used).alias("factors"),
        no_rows(col("result_groups")).alias("groups"), ensemble.alias("ensemble"), F.coalesce("hybrid", no).alias("hybrid"), "n_interactions",
        F.when(ensemble, no_rows(F.transform("perspectives", lambda p: p["id"]))).alias("views"),
        F.when(ensemble, F.transform("priors", lambda p: p["id"])).alias("prior_ids"), no_rows(given).alias("given"),
        "central_prior_id", "fit_only_prior_id", no_rows(col("excluded")).alias("excluded"), col("evidence").isNotNull().alias("empirical"), no_rows(chosen).alias("chosen"))
    rows = rows.select("*", no_rows(each(col("factors"), value)).alias("conditions"), no_rows(each(col("factors"), entry)).alias("effects"),
                       F.array_distinct(F.transform("given", lambda g: g["prior_id"])).alias("given_ids"),
                       F.array_distinct(F.transform("chosen", lambda s: s["choice_id"])).alias("chosen_ids"))
    of_prior = F.transform("given_ids", lambda p: F.struct(p.alias("id"), F.transform(F.filter("given", lambda g: g["prior_id"].eqNullSafe(p)), lambda g: g["value"]).alias("v")))
    rows = rows.select("*", F.transform(of_prior, lambda p: F.struct(p["id"].alias("id"), total(p["v"]).alias("s"), F.array_min(p["v"]).alias("mn"),
                                                                     F.array_max(p["v"]).alias("mx"))).alias("per_prior"))
    choices, keys, factors, views, chosen, own = col("choices"), col("keys"), col("factors"), col("views"), col("chosen"), col("given")

    # A1, A2
    n = size(F.array_compact(choices))
    one("A1 choice_count", (n < 2) | (n > 4), n)
    many("A1 duplicate_choice", twice(choices), lambda c: c)
    many("A1 reserved_choice_id", F.filter(choices, lambda c: c == DRAW_SUFFIX), lambda c: c)
    many("A2 prior_keys", F.filter(keys, lambda c: ~within(choices, c)), lambda c: F.concat(c, lit(":extra")))
    many("A2 prior_keys", F.filter(choices, lambda c: ~within(keys, c)), lambda c: F.concat(c, lit(":missing")))
    s = total(col("scores"))
    one("A2 prior_sum", (size(F.array_compact("scores")) > 0) & ((s < lo) | (s > hi)), lit(f"outside [{lo}, {hi}]"))

    # A3, A4: names are suggested and values looked up further down
    hits.append(F.transform(F.filter(factors, lambda f: ~f["known"]), lambda f: hit("A3 unknown_attribute", lit(None), f["attribute"])))
    named = lambda c: F.concat(c["attribute"], lit("="), c["condition"])
    illegal = lambda c: c["known"] & ~listed(pair(c["attribute"], c["condition"]))
    many("A4 invalid_condition", F.filter("conditions", illegal), named)
    many("A4 empty_conditions", F.filter(factors, lambda f: count(f["conditions"]) == 0), lambda f: f["attribute"])
    if seen is not None:
        hits.append(F.transform(F.filter("conditions", lambda c: looked_at(c["attribute"])), lambda c: hit("A4 unobserved_condition", lit(None), c["attribute"], c["condition"])))

    # A5, A6
    effect = lambda e: F.concat(e["attribute"], lit(":"), e["choice_id"])
    many("A5 unknown_choice", F.filter("effects", lambda e: ~within(choices, e["choice_id"])), effect)
    many("A5 effect_too_large", F.filter("effects", lambda e: F.abs(e["effect"]) > MAX_ABS_EFFECT), effect)
    many("A5 empty_effects", F.filter(factors, lambda f: count(f["effects"]) == 0), lambda f: f["attribute"])
    if sensitive_pattern:
        many("A6 sensitive_attribute", F.filter(factors, lambda f: f["attribute"].rlike("(?i)" + sensitive_pattern)), lambda f: f["attribute"])

    # A8, factor count, A11
    many("A8 unsupported_group", F.filter("groups", lambda g: ~breakdown(g)), lambda g: g)
    one("A8 too_many_groups", size("groups") > MAX_GROUPS, size("groups"))
    of_set = lambda v: size(F.filter(factors, lambda f: f["perspective_id"].eqNullSafe(v)))
    per_set = F.transform(F.array_distinct(F.transform(factors, lambda f: f["perspective_id"])), of_set)
    many("S max_factors", F.when(size(factors) > MAX_FACTORS, F.filter(per_set, lambda n: n > MAX_FACTORS)), lambda n: n)
    n = size(F.array_compact(views))
    one("A11 perspective_count", (n < 3) | (n > 5), n)
    many("A11 duplicate_perspective", twice(views), lambda v: v)
    in_view = F.transform(views, lambda v: F.struct(v.alias("id"), F.when(v.isNull(), 0).otherwise(of_set(v)).alias("n")))
    many("A11 perspective_factors", F.filter(in_view, lambda v: (v["n"] < 2) | (v["n"] > 6)), lambda v: F.concat(v["id"], lit(":"), v["n"].cast("string")))

    # A10, A7
    n = size(F.array_compact("given_ids"))
    one("A10 prior_count", col("hybrid") & ((n < 3) | (n > 5)), n)
    many("A10 duplicate_prior", twice(col("prior_ids")), lambda p: p)

    many("A10 prior_values", F.filter("per_prior", lambda p: p["mn"].isNotNull() & ((p["mn"] <= 0) | (p["mx"] > 1) | (p["s"] < lo) | (p["s"] > hi))), lambda p: p["id"])
    many("A10 fit_only_unequal", F.filter("per_prior", lambda p: (p["id"] == col("fit_only_prior_id")) & (p["mx"] - p["mn"] > 0.001)), lambda p: p["id"])
    scored = lambda g: F.concat(g["prior_id"], lit(":"), g["choice_id"])
    many("A10 prior_keys", F.filter(own, lambda g: g["prior_id"].isNull() | ~within(choices, g["choice_id"])), scored)
    wanted = each(col("given_ids"), lambda p: F.transform(choices, lambda c: F.struct(p.alias("prior_id"), c.alias("choice_id"))))
    many("A10 prior_keys", F.filter(wanted, lambda w: ~F.exists(own, lambda g: F.coalesce((g["prior_id"] == w["prior_id"]) & (g["choice_id"] == w["choice_id"]), no))), scored)
    for ref, check in (("central_prior_id", "A10 central_missing"), ("fit_only_prior_id", "A10 fit_only_missing")):
        one(check, col("hybrid") & ~within(col("given_ids"), col(ref)), F.coalesce(col(ref), lit("NULL")))
    many("A10 unknown_excluded", F.filter("excluded", lambda a: ~known(a)), lambda a: a)
    one("A10 no_excluded", col("hybrid") & (size("excluded") == 0), lit(""))
    one("A7 interactions", col("n_interactions") > 0, col("n_interactions"))

    # A9, A10, E13
    many("A9 evidence_keys", F.filter("chosen_ids", lambda c: ~within(choices, c)), lambda c: F.concat(c, lit(":extra")))
    many("A9 evidence_keys", F.when(col("empirical"), F.filter(choices, lambda c: ~within(col("chosen_ids"), c))), lambda c: F.concat(c, lit(":missing")))
    per_choice = F.transform("chosen_ids", lambda c: F.struct(c.alias("id"), size(F.filter(chosen, lambda s: s["choice_id"] == c)).alias("n")))
    many("A9 selector_count", F.filter(per_choice, lambda c: c["n"] > 3), lambda c: F.concat(c["id"], lit(":"), c["n"].cast("string")))
    many("A9 unknown_evidence", F.filter(chosen, lambda s: ~s["known"]), lambda s: s["attribute"])
    many("A9 empty_selector", F.filter(chosen, lambda s: count(s["conditions"]) == 0), lambda s: s["attribute"])
    many("A9 invalid_selector_value", F.filter(each(chosen, value), illegal), named)
    one("A10 evidence_and_hybrid", col("empirical") & col("hybrid"), lit(""))
    direct = F.concat("excluded", F.transform(chosen, lambda s: s["attribute"]))
    many("E13 evidence_leak", F.filter(factors, lambda f: within(direct, f["attribute"])), lambda f: F.concat(f["perspective_id"], lit(":"), f["attribute"]))

    found = rows.select("rule_id", F.explode(F.concat(*[F.coalesce(h, F.array().cast(_HITS)) for h in hits])).alias("h")).select("rule_id", "h.*")
    found = _looked_up(found, near, ["attribute"], "left", near.count())
    suggestion = F.concat(col("attribute"), lit(" -> "), F.coalesce("known", lit("none")))
    found = found.withColumn("detail", F.when(col("check") == "A3 unknown_attribute", suggestion).when(
        col("check") == "A4 unobserved_condition", F.concat("attribute", lit("="), "condition")).otherwise(col("detail"))).drop("known")
    if seen is not None:
        found = _looked_up(found, seen.withColumn("_seen", lit(True)), ["attribute", "condition"], "left", seen.count()).where(
            (col("check") != "A4 unobserved_condition") | col("_seen").isNull())
    return found.select("rule_id", "check", "detail")


def _finding(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select("rule_id", F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def audit(spark: SparkSession, rules: Mapping[str, Rule | Ensemble], catalog: Catalog,
          profile: DataFrame | None = None, sensitive_pattern: str | None = None) -> DataFrame:
    """Findings of rules given as configuration."""
    rows = flatten(rules)
    tables = {k: spark.createDataFrame(rows[k], SCHEMAS[k]).coalesce(1) for k in SCHEMAS}
    return audit_tables(spark, tables, catalog, profile, sensitive_pattern, {k: len(v) for k, v in rows.items()},
                        sorted({r[3] for r in rows["conditions"]}))


def require_valid(spark: SparkSession, rules: Mapping[str, Rule | Ensemble], catalog: Catalog, sensitive_pattern: str | None = None) -> None:
    """Raises before any scoring if a rule has findings (as many at most as its configuration has rows)."""
    found = [f"{r.rule_id}: {r.check} {r.detail}" for r in audit(spark, rules, catalog, None, sensitive_pattern).collect()]
    if found:
        raise ValueError("invalid rules: " + "; ".join(sorted(found)))


def problems(rule: Rule | Ensemble, catalog: Catalog) -> list[str]:
    """The findings that stop a single configured rule, without a Spark job (``check detail``); for many rules see ``audit``."""
    out: list[str] = []

    def unless(ok: bool, check: str, detail: object) -> None:
        if not ok:
            out.append(f"{check} {detail}")

    lo, hi = PRIOR_SUM_TOLERANCE
    ids = [c.id for c in rule.choices]
    is_ens = isinstance(rule, Ensemble)
    unless(2 <= len(ids) <= 4, "A1 choice_count", len(ids))
    unless(len(ids) == len(set(ids)), "A1 duplicate_choice", ids)
    unless(set(rule.base_scores) == set(ids), "A2 prior_keys", sorted(rule.base_scores))
    unless(lo <= sum(rule.base_scores.values()) <= hi, "A2 prior_sum", sum(rule.base_scores.values()))
    unless(set(rule.result_groups) <= set(catalog.breakdowns), "A8 unsupported_group", sorted(set(rule.result_groups) - set(catalog.breakdowns)))
    unless(len(rule.result_groups) <= MAX_GROUPS, "A8 too_many_groups", len(rule.result_groups))
    unless(not getattr(rule, "interactions", ()), "A7 interactions", "reserved")
    sets = [(p.id, p.factors) for p in rule.perspectives] if is_ens else [("", rule.factors)]
    for name, factors in sets:
        unless(len(factors) <= MAX_FACTORS, "S max_factors", len(factors))
        unless(not is_ens or 2 <= len(factors) <= 6, "A11 perspective_factors", f"{name}:{len(factors)}")
        for f in factors:
            known = f.attribute in catalog.attributes
            unless(known, "A3 unknown_attribute", f.attribute)
            unless(not known or set(f.conditions) <= set(catalog.attributes[f.attribute]), "A4 invalid_condition", f.attribute)
            unless(bool(f.conditions), "A4 empty_conditions", f.attribute)
            unless(set(f.effects) <= set(ids), "A5 unknown_choice", f.attribute)
            unless(all(abs(v) <= MAX_ABS_EFFECT for v in f.effects.values()), "A5 effect_too_large", f.attribute)
            unless(bool(f.effects), "A5 empty_effects", f.attribute)
    if is_ens:
        names = [p.id for p in rule.perspectives]
        unless(3 <= len(names) <= 5, "A11 perspective_count", len(names))
        unless(len(names) == len(set(names)), "A11 duplicate_perspective", names)
    return out


def require_sound(rule: Rule | Ensemble, catalog: Catalog) -> None:
    """Raises before any scoring if the configured rule has problems."""
    if found := problems(rule, catalog):
        raise ValueError("invalid rule: " + "; ".join(found))


def audit_tables(spark: SparkSession, t: Mapping[str, DataFrame], catalog: Catalog, profile: DataFrame | None = None,
                 sensitive_pattern: str | None = None, size: Mapping[str, int] | None = None, used: Sequence[str] | None = None,
                 seen: DataFrame | None = None) -> DataFrame:
    """Findings of stored rules, given as the tables of SCHEMAS. ``size``: row
    bounds of tables that may be broadcast; ``used``: attributes to look up in
    the profile (default: all of the catalog); ``seen``: its values, if at hand."""

    def small(name: str, df: DataFrame | None = None) -> DataFrame:
        # any frame derived from one rule table has at most that table's rows
        side = t[name] if df is None else df
        return side if size is None else bounded_broadcast(side, size[name])

    def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
        # a few keys may be in most rows of unbounded tables
        return _looked_up(rows, table, keys, how) if size is None else rows.join(table, list(keys), how)

    n_values = sum(len(v) for v in catalog.attributes.values())
    dic = bounded_broadcast(catalog.to_frame(spark).select("attribute", "value"), n_values)
    known = _known(spark, catalog)
    breakdowns = bounded_broadcast(spark.createDataFrame([(a,) for a in catalog.breakdowns], "grp string"), len(catalog.breakdowns))
    lo, hi = PRIOR_SUM_TOLERANCE
    out = []

    # A1 choices: 2..4, unique ids
    n_choices = t["meta"].select("rule_id").join(t["choices"], "rule_id", "left").groupBy("rule_id").agg(F.count("choice_id").alias("n"))
    out.append(_finding(n_choices.where((F.col("n") < 2) | (F.col("n") > 4)), "A1 choice_count", F.col("n")))
    out.append(_finding(t["choices"].groupBy("rule_id", "choice_id").count().where("count > 1"), "A1 duplicate_choice", F.col("choice_id")))
    # a choice named like the sampled-mode draw shares its noise hash
    out.append(_finding(t["choices"].where(F.col("choice_id") == DRAW_SUFFIX), "A1 reserved_choice_id", F.col("choice_id")))

    # A2 authored prior: keys equal the choice ids; sum within tolerance
    authored = t["priors"].where(F.col("role") == "authored")
    keys = authored.select("rule_id", "choice_id", F.lit(1).alias("p")).join(
        t["choices"].select("rule_id", "choice_id", F.lit(1).alias("c")), ["rule_id", "choice_id"], "full")
    out.append(_finding(keys.where(F.col("p").isNull() | F.col("c").isNull()), "A2 prior_keys",
                        F.concat(F.col("choice_id"), F.when(F.col("p").isNull(), F.lit(":missing")).otherwise(F.lit(":extra")))))
    sums = authored.groupBy("rule_id").agg(F.sum("value").alias("s"))
    out.append(_finding(sums.where((F.col("s") < lo) | (F.col("s") > hi)), "A2 prior_sum", F.lit(f"outside [{lo}, {hi}]")))

    # A3 unknown factor attribute (a close name is suggested, never substituted)
    unknown = t["factors"].join(known, "attribute", "left_anti")
    named = looked_up(unknown, _suggested(unknown, known), ["attribute"], "left")
    out.append(_finding(named, "A3 unknown_attribute", F.concat(F.col("attribute"), F.lit(" -> "), F.coalesce("known", F.lit("none")))))

    # A4 conditions: legal values of known attributes; non-empty
    conds_known = t["conditions"].join(known, "attribute", "left_semi")
    bad = conds_known.join(dic.withColumnRenamed("value", "condition"), ["attribute", "condition"], "left_anti")
    out.append(_finding(bad, "A4 invalid_condition", F.concat(F.col("attribute"), F.lit("="), F.col("condition"))))
    out.append(_finding(t["factors"].where("n_conditions = 0"), "A4 empty_conditions", F.col("attribute")))
    attrs = _looked_at(catalog, profile, used)
    if attrs:
        seen = _observed(profile, attrs) if seen is None else seen
        unseen = looked_up(t["conditions"].join(known.where(F.col("attribute").isin(*attrs)), "attribute", "left_semi"), seen, ["attribute", "condition"], "left_anti")
        out.append(_finding(unseen, "A4 unobserved_condition", F.concat(F.col("attribute"), F.lit("="), F.col("condition"))))

    # A5 effects: known choices, |effect| <= 0.25, non-empty
    eff_unknown = t["effects"].join(small("choices", t["choices"].select("rule_id", "choice_id")), ["rule_id", "choice_id"], "left_anti")
    out.append(_finding(eff_unknown, "A5 unknown_choice", F.concat(F.col("attribute"), F.lit(":"), F.col("choice_id"))))
    out.append(_finding(t["effects"].where(F.abs("effect") > MAX_ABS_EFFECT), "A5 effect_too_large",
                        F.concat(F.col("attribute"), F.lit(":"), F.col("choice_id"))))
    out.append(_finding(t["factors"].where("n_effects = 0"), "A5 empty_effects", F.col("attribute")))

    # A6 sensitive attributes cannot drive choices
    if sensitive_pattern:
        out.append(_finding(t["factors"].where(F.col("attribute").rlike("(?i)" + sensitive_pattern)), "A6 sensitive_attribute",
                            F.col("attribute")))

    # A8 result groups: supported breakdowns, at most three
    out.append(_finding(t["groups"].join(breakdowns, "grp", "left_anti"), "A8 unsupported_group", F.col("grp")))
    n_groups = t["groups"].groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    out.append(_finding(n_groups.where(F.col("n") > MAX_GROUPS), "A8 too_many_groups", F.col("n")))

    # factor count per rule / perspective
    per_set = t["factors"].groupBy("rule_id", "perspective_id").agg(F.count(F.lit(1)).alias("n"))
    out.append(_finding(per_set.where(F.col("n") > MAX_FACTORS), "S max_factors", F.col("n")))

    # A11 ensembles: 3..5 perspectives, unique ids, 2..6 factors each
    ens_ids = t["meta"].where(F.col("kind") == "ensemble").select("rule_id")
    n_persp = ens_ids.join(small("perspectives"), "rule_id", "left").groupBy("rule_id").agg(F.count("perspective_id").alias("n"))
    out.append(_finding(n_persp.where((F.col("n") < 3) | (F.col("n") > 5)), "A11 perspective_count", F.col("n")))
    out.append(_finding(t["perspectives"].groupBy("rule_id", "perspective_id").count().where("count > 1"),
                        "A11 duplicate_perspective", F.col("perspective_id")))
    persp_factors = t["perspectives"].join(small("factors", per_set), ["rule_id", "perspective_id"], "left").select(
        "rule_id", "perspective_id", F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n"))
    out.append(_finding(persp_factors.where((F.col("n") < 2) | (F.col("n") > 6)), "A11 perspective_factors",
                        F.concat(F.col("perspective_id"), F.lit(":"), F.col("n").cast("string"))))

    # A10 hybrid priors
    hyb = t["meta"].where("hybrid")
    hp = t["priors"].where(F.col("role") == "hybrid").join(small("meta", hyb.select("rule_id")), "rule_id", "left_semi")
    n_priors = hyb.select("rule_id").join(small("priors", hp), "rule_id", "left").groupBy("rule_id").agg(F.count_distinct("prior_id").alias("n"))
    out.append(_finding(n_priors.where((F.col("n") < 3) | (F.col("n") > 5)), "A10 prior_count", F.col("n")))
    out.append(_finding(t["hybrid_priors"].groupBy("rule_id", "prior_id").count().where("count > 1"), "A10 duplicate_prior", F.col("prior_id")))
    per_prior = hp.groupBy("rule_id", "prior_id").agg(
        F.sum("value").alias("s"), F.min("value").alias("mn"), F.max("value").alias("mx"))
    out.append(_finding(per_prior.where((F.col("mn") <= 0) | (F.col("mx") > 1) | (F.col("s") < lo) | (F.col("s") > hi)),
                        "A10 prior_values", F.col("prior_id")))
    fit = per_prior.join(small("meta", hyb.select("rule_id", F.col("fit_only_prior_id").alias("prior_id"))), ["rule_id", "prior_id"], "left_semi")
    out.append(_finding(fit.where(F.col("mx") - F.col("mn") > 0.001), "A10 fit_only_unequal", F.col("prior_id")))
    hp_keys = hp.select("rule_id", "prior_id", "choice_id", F.lit(1).alias("p")).join(
        hp.select("rule_id", "prior_id").distinct().join(small("choices", t["choices"].select("rule_id", "choice_id", F.lit(1).alias("c"))), "rule_id"),
        ["rule_id", "prior_id", "choice_id"], "full")
    out.append(_finding(hp_keys.where(F.col("p").isNull() | F.col("c").isNull()), "A10 prior_keys",
                        F.concat(F.col("prior_id"), F.lit(":"), F.col("choice_id"))))
    ids = hp.select("rule_id", "prior_id").distinct()
    for col, check in (("central_prior_id", "A10 central_missing"), ("fit_only_prior_id", "A10 fit_only_missing")):
        ref = hyb.select("rule_id", F.col(col).alias("prior_id"))
        out.append(_finding(ref.join(small("priors", ids), ["rule_id", "prior_id"], "left_anti"), check, F.coalesce(F.col("prior_id"), F.lit("NULL"))))
    excluded = t["direct"].where(F.col("role") == "excluded")
    out.append(_finding(excluded.join(known, "attribute", "left_anti"), "A10 unknown_excluded", F.col("attribute")))
    out.append(_finding(hyb.join(small("direct", excluded), "rule_id", "left_anti"), "A10 no_excluded", F.lit("")))

    # A7 interactions are reserved
    out.append(_finding(t["meta"].where(F.col("n_interactions") > 0), "A7 interactions", F.col("n_interactions")))

    # A9 empirical evidence: keys = choice ids, 1..3 selectors each, known
    # attributes, non-empty legal conditions; A10 exclusive with hybrid priors
    emp = t["meta"].where("empirical")
    ev_keys = t["selectors"].select("rule_id", "choice_id").distinct().select("rule_id", "choice_id", F.lit(1).alias("e")).join(
        t["choices"].join(small("meta", emp.select("rule_id")), "rule_id", "left_semi").select("rule_id", "choice_id", F.lit(1).alias("c")),
        ["rule_id", "choice_id"], "full")
    out.append(_finding(ev_keys.where(F.col("e").isNull() | F.col("c").isNull()), "A9 evidence_keys",
                        F.concat(F.col("choice_id"), F.when(F.col("e").isNull(), F.lit(":missing")).otherwise(F.lit(":extra")))))
    n_sel = t["selectors"].groupBy("rule_id", "choice_id").agg(F.count(F.lit(1)).alias("n"))
    out.append(_finding(n_sel.where((F.col("n") < 1) | (F.col("n") > 3)), "A9 selector_count",
                        F.concat(F.col("choice_id"), F.lit(":"), F.col("n").cast("string"))))
    evid = t["direct"].where(F.col("role") == "evidence")
    out.append(_finding(evid.join(known, "attribute", "left_anti"), "A9 unknown_evidence", F.col("attribute")))
    out.append(_finding(t["selectors"].where("n_conditions = 0"), "A9 empty_selector", F.col("attribute")))
    sel_known = t["selector_values"].join(known, "attribute", "left_semi")
    out.append(_finding(sel_known.join(dic.withColumnRenamed("value", "condition"), ["attribute", "condition"], "left_anti"),
                        "A9 invalid_selector_value", F.concat(F.col("attribute"), F.lit("="), F.col("condition"))))
    out.append(_finding(t["meta"].where(F.col("empirical") & F.col("hybrid")), "A10 evidence_and_hybrid", F.lit("")))
    leak = t["factors"].join(small("direct", t["direct"].select("rule_id", "attribute").distinct()), ["rule_id", "attribute"], "left_semi")
    out.append(_finding(leak, "E13 evidence_leak", F.concat(F.col("perspective_id"), F.lit(":"), F.col("attribute"))))

    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result
