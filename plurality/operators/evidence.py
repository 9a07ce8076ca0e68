"""Evidence counts, empirical prior and factor coverage.

Each report is one global aggregate with many conditional counts, i.e. one
scan and a shuffle of one partial row per task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions.sqltext import sql_literal
from plurality.operators.shares import pct
from plurality.spec import Evidence, Factor, Selector


def selector_match(sel: Selector) -> Column:
    """attribute IN (conditions); NULL attribute -> NULL (not a match)."""
    return F.col(sel.attribute).isin(*sel.conditions)


def any_match(selectors: Sequence[Selector]) -> Column:
    return reduce(or_, [selector_match(s) for s in selectors])


def any_observed(selectors: Sequence[Selector]) -> Column:
    return reduce(or_, [F.col(s.attribute).isNotNull() for s in selectors])


def evidence_counts(df: DataFrame, evidence: Evidence, choices: Sequence[str]) -> DataFrame:
    """One row: n, any_match, matched{i}, valid{i} (three-valued: only TRUE counts)."""
    cols = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(choices):
        cols.append(F.count_if(any_match(evidence.selectors[c])).alias(f"matched{i}"))
        cols.append(F.count_if(any_observed(evidence.selectors[c])).alias(f"valid{i}"))
    cols.append(F.count_if(reduce(or_, [any_match(evidence.selectors[c]) for c in choices])).alias("any_match"))
    return df.agg(*cols)


def evidence_report(df: DataFrame, evidence: Evidence, choices: Sequence[str], digits: int = 6,
                    counts: DataFrame | None = None) -> DataFrame:
    """Per choice: matched, valid, missing, matched % of all, share of all
    matches, plus any-match count and % (repeated per row). ``counts``: a
    precomputed ``evidence_counts`` row."""
    counts = evidence_counts(df, evidence, choices) if counts is None else counts
    total = " + ".join(f"matched{i}" for i in range(len(choices)))
    rows = ", ".join(f"{i}, {sql_literal(c)}, matched{i}, valid{i}" for i, c in enumerate(choices))
    long = counts.selectExpr("n", "any_match", f"{total} AS _matched_all",
                             f"stack({len(choices)}, {rows}) AS (choice_index, choice, matched, valid)")
    return long.selectExpr(
        "n", "any_match", f"round(try_divide(any_match * 100.0D, CAST(n AS DOUBLE)), {digits}) AS any_match_pct",
        "choice_index", "choice", "matched", "valid", "n - valid AS missing",
        f"round(try_divide(matched * 100.0D, CAST(n AS DOUBLE)), {digits}) AS matched_pct_all",
        f"round(try_divide(matched * 100.0D, CAST(_matched_all AS DOUBLE)), {digits}) AS share_of_matches",
    )


def empirical_prior(df: DataFrame, evidence: Evidence, choices: Sequence[str], authored: Mapping[str, float],
                    counts: DataFrame | None = None) -> DataFrame:
    """matched_i / sum(matched); when nothing matched, the authored prior.
    Output ``choice_index, choice, prior, source``."""
    counts = evidence_counts(df, evidence, choices) if counts is None else counts
    total = reduce(lambda a, b: a + b, [F.col(f"matched{i}") for i in range(len(choices))])
    items = [
        F.struct(
            F.lit(i).alias("choice_index"),
            F.lit(c).alias("choice"),
            F.when(total == 0, F.lit(float(authored[c]))).otherwise(F.col(f"matched{i}") / total.cast("double")).alias("prior"),
            F.when(total == 0, F.lit("authored")).otherwise(F.lit("empirical")).alias("source"),
        )
        for i, c in enumerate(choices)
    ]
    return counts.select(F.inline(F.array(*items)))


def coverage_keys(factors: Sequence[Factor]) -> list[tuple[str, tuple[str, ...]]]:
    """Distinct (attribute, ordered conditions) in first-seen order."""
    return list(dict.fromkeys((f.attribute, tuple(f.conditions)) for f in factors))


def coverage_aggs(keys: Sequence[tuple[str, tuple[str, ...]]], where: Column | None = None) -> list[Column]:
    """Aggregate columns of a coverage report (to fold into another pass), over the rows that satisfy ``where``."""
    here = F.lit(True) if where is None else where
    cols = [F.count_if(here).alias("n")]
    for i, (a, conds) in enumerate(keys):
        cols.append(F.count_if(here & F.col(a).isNotNull()).alias(f"valid{i}"))
        cols.append(F.count_if(here & F.col(a).isin(*conds)).alias(f"matched{i}"))
    return cols


def coverage_rows(row: DataFrame, keys: Sequence[tuple[str, tuple[str, ...]]], digits: int = 6,
                  extra: Sequence[Sequence[tuple[str, object]]] | None = None) -> DataFrame:
    """Long coverage rows from a one-row aggregate holding ``coverage_aggs``
    (reshaped with ``stack``). ``extra``: per key, (column name, value)
    metadata pairs."""
    names = [n for n, _ in extra[0]] if extra else []
    rows = []
    if not keys:  # no factors, no rows
        empty = "CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)"
        rows.append("CAST(NULL AS INT), " + empty)
    for i, (a, conds) in enumerate(keys):
        meta = "".join(", " + sql_literal(v) for _, v in (extra[i] if extra else []))
        rows.append(f"{i}, {sql_literal(a)}, {sql_literal('|'.join(conds))}, valid{i}, matched{i}{meta}")
    cols = ", ".join(["key_index", "attribute", "conditions", "valid", "matched", *names])
    long = row.selectExpr("n", f"stack({len(rows)}, {', '.join(rows)}) AS ({cols})").where("key_index IS NOT NULL")
    return long.selectExpr(
        "n", "key_index", "attribute", "conditions", "valid", "n - valid AS missing", "matched",
        f"round(try_divide(matched * 100.0D, CAST(n AS DOUBLE)), {digits}) AS matched_pct_all",
        f"CASE WHEN valid > 0 THEN round(try_divide(matched * 100.0D, CAST(valid AS DOUBLE)), {digits}) ELSE 0.0D END"
        " AS matched_pct_valid",
        *names,
    )


def coverage(
    df: DataFrame,
    keys: Sequence[tuple[str, tuple[str, ...]]],
    digits: int = 6,
    extra: Sequence[Sequence[tuple[str, object]]] | None = None,
) -> DataFrame:
    """Per key: valid (non-NULL), missing, matched, % of all, % of valid (0 when
    nothing is valid). ``extra`` adds literal columns per key: (name, value).
    Output ``key_index, attribute, conditions, n, valid, missing, matched,
    matched_pct_all, matched_pct_valid, *extra``."""
    return coverage_rows(df.agg(*coverage_aggs(keys)), keys, digits, extra)
