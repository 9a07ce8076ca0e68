"""Stored rules derived from orders: one rule or ensemble per order key, with planted faults.

Every fault depends on the key modulo a small number, so that single faults,
combinations and faultless rules all occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.operators.audit import STORED_RULE


def _pick(key: Column, modulus: int, cases: dict[int, Column], otherwise: Column) -> Column:
    out = None
    for rest, value in cases.items():
        out = F.when(key % modulus == rest, value) if out is None else out.when(key % modulus == rest, value)
    return out.otherwise(otherwise)


def _effects(**values: float) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _factor(attribute: Column, conditions: Column, effects: Column) -> Column:
    return F.struct(attribute.alias("attribute"), conditions.alias("conditions"), effects.alias("effects"))


def stored_rules(orders: DataFrame) -> DataFrame:
    """STORED_RULE rows of ``orders`` (o_orderkey)."""
    k = F.col("o_orderkey")
    ensemble = k % 5 == 0
    attribute = _pick(k, 7, {0: F.lit("priorty"), 1: F.lit("c_phone")}, F.lit("priority"))
    conditions = _pick(k, 7, {2: _texts("1-URGENT", "9-NEVER"), 3: _texts()}, _texts("1-URGENT"))
    effects = _pick(k, 7, {4: _effects(a=0.4), 5: _effects(z=0.1), 6: _effects()}, _effects(a=0.1))
    # every order's own factor is worked out once, in projections before the ones that use it
    orders = orders.select(k, _factor(attribute, conditions, effects).alias("first"))
    first = F.col("first")
    second = _factor(F.lit("basket"), _texts("large"), _effects(b=0.1))
    orders = orders.select(k, first, F.array(first, second).alias("pair"))
    many = F.array_repeat(first, 13)
    factors = F.when(ensemble, F.array().cast("array<struct<attribute:string,conditions:array<string>,effects:map<string,double>>>")).when(
        k % 19 == 0, many).otherwise(F.col("pair"))
    view = lambda name, fs: F.struct(F.lit(name).alias("id"), fs.alias("factors"))
    pair, single = F.col("pair"), F.array(second)
    views = _pick(k, 3, {0: F.array(view("p1", pair), view("p2", pair)), 1: F.array(view("p1", pair), view("p1", pair), view("p2", single), view("p3", pair))},
                  F.array(view("p1", pair), view("p2", pair), view("p3", F.array(first, _factor(F.lit("status"), _texts("F"), _effects(a=0.1))))))
    prior = lambda name, *v: F.struct(F.lit(name).alias("id"), _effects(**dict(zip("abc", v))).alias("base_scores"))
    priors = _pick(k, 4, {0: F.array(prior("equal", 0.4, 0.3, 0.3), prior("central", 0.5, 0.3, 0.2)),
                          2: F.array(prior("equal", 0.3334, 0.3333, 0.3333), prior("central", 0.5, 0.3, 0.1), prior("strong", 1.2, -0.4, 0.2), prior("strong", 1.2, -0.4, 0.2))},
                   F.array(prior("equal", 0.3334, 0.3333, 0.3333), prior("central", 0.5, 0.3, 0.2), prior("strong", 0.7, 0.2, 0.1)))
    hybrid = ensemble & (k % 2 == 0)
    selector = lambda name, *v: F.struct(F.lit(name).alias("attribute"), _texts(*v).alias("conditions"))
    evidence = F.create_map(F.lit("a"), F.array(selector("priority", "1-URGENT", "0-NOW"), selector("segment"), selector("basket", "large"), selector("returned", "Y")),
                            F.lit("b"), F.array(selector("colour", "red")), F.lit("q"), F.array(selector("region", "ASIA")))
    columns = {
        "rule_id": F.concat(F.lit("r"), k.cast("string")),
        "kind": F.when(ensemble, F.lit("ensemble")).otherwise(F.lit("rule")),
        "choices": _pick(k, 11, {0: _texts("a"), 1: _texts("a", "a", "b"), 2: _texts("a", "b", "sample")}, _texts("a", "b", "c")),
        "base_scores": _pick(k, 13, {0: _effects(a=0.5, b=0.3), 1: _effects(a=0.5, b=0.3, c=0.2, d=0.0)}, _effects(a=0.5, b=0.3, c=0.2)),
        "factors": factors,
        "result_groups": _pick(k, 9, {0: _texts("region", "segment"), 1: _texts("region", "status", "region", "status")}, _texts("region")),
        "n_interactions": F.when(k % 17 == 0, F.lit(2)).otherwise(F.lit(0)),
        "perspectives": F.when(ensemble, views),
        "priors": F.when(hybrid, priors),
        "hybrid": hybrid,
        "central_prior_id": F.when(hybrid, F.when(k % 20 == 0, F.lit("nope")).otherwise(F.lit("central"))),
        "fit_only_prior_id": F.when(hybrid, F.when(k % 30 == 0, F.lit(None)).otherwise(F.lit("equal"))),
        "excluded": F.when(hybrid, _pick(k, 6, {0: _texts(), 2: _texts("status", "planet")}, _texts("status"))),
        "evidence": F.when(ensemble & ((k % 2 == 1) | (k % 50 == 0)), evidence),
    }
    schema = T.StructType.fromDDL(STORED_RULE)
    return orders.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema])
