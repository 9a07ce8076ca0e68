"""Single-rule report: every block of the result document, and its JSON edge.

One scan: a ``shares.cube`` holds the total, every breakdown group and every 1-
and 2-way segment, with row counts, probability sums and the indicator sums for
missing cells and factor coverage. Its size follows the rule, not the data; it
is checkpointed with its own partitions into the shared folder (lineage cut,
survives executor loss) and every block is derived from it. NULL-key rows are
counted in the same pass.

JSON is produced only at the edge: one nested document with the sorted rows of
every block, NULL fields included (``as_document``), or a row per block
(``as_json_rows``); ``from_document`` and ``from_json_rows`` read typed rows back.

A rule with problems is refused before anything is scored.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators import scoring, shares
from plurality.operators.audit import require_sound
from plurality.operators.evidence import coverage_aggs, coverage_rows
from plurality.session import shared_dir
from plurality.spec import Catalog, Rule

TOP_FACTORS = 3


def factor_keys(rule: Rule) -> list[tuple[str, tuple[str, ...]]]:
    return [(f.attribute, tuple(f.conditions)) for f in rule.factors]


def rule_report(spark: SparkSession, profile: DataFrame, rule: Rule, catalog: Catalog, mode: str = "expected",
                digits: int = 6) -> dict[str, DataFrame]:
    """All report blocks from one scan of the profile; a block the rule has nothing for is left out."""
    require_sound(rule, catalog)
    n, keys = len(rule.choices), factor_keys(rule)
    scored = scoring.probabilities(profile, rule, mode=mode, null_keys=True)
    keyed = F.col(scoring.KEY).isNotNull()
    # NULL-key rows have no probabilities and count for nothing but their number
    attrs = rule.factor_attributes()
    missing = [F.count_if(keyed & F.col(a).isNull()) for a in attrs]
    extra = [F.count_if(~keyed).alias("_null_keys"), (sum(missing[1:], missing[0]) if missing else F.lit(0)).cast("bigint").alias("_missing")]
    extra += [c for c in coverage_aggs(keys, where=keyed)[1:]]
    cells = shares.cube(scored, rule, catalog, rule.result_groups, (1, 2), extra=extra, where=keyed)
    shared_dir(spark)
    cells = cells.checkpoint(eager=True)
    total = shares.cube_total(cells).select(
        "n", "_null_keys", "_missing", *[F.col(f"_sum_{scoring.prob_col(i)}").alias(f"t{i}") for i in range(n)],
        *[c for k in range(len(keys)) for c in (f"valid{k}", f"matched{k}")])
    segs = shares.segments(None, rule, catalog, digits=digits, cells=cells)
    strongest = shares.top_factors(shares.factor_effects(spark, [("", p, f) for p, f in enumerate(rule.factors)], rule.choice_ids), TOP_FACTORS)
    counts = coverage_rows(total, keys, digits).select(F.col("key_index").alias("factor_position"), "valid", "matched")
    blocks = {
        "rows": total.select((F.col("n") + F.col("_null_keys")).alias("n_rows"), F.col("n").alias("n_scored"), F.col("_null_keys").alias("n_null_key")),
        "choices": shares.counted_rows(total, rule, digits),
        "groups": shares.breakdown(None, rule, catalog, digits=digits, cells=cells) if rule.result_groups else None,
        "preference_groups": shares.best_segments(spark, segs, rule),
        "missing": total.select(F.col("n").alias("n_units"), F.col("_missing").alias("missing_cells")),
        "top_factors": strongest.join(counts, "factor_position").select(
            "rank", "factor_position", "attribute", "conditions", "max_abs_effect", "valid", "matched") if keys else None,
    }
    return {k: v for k, v in blocks.items() if v is not None}


def as_json_rows(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per block: ``block, json`` where json is the block's rows as a
    sorted JSON array (deterministic regardless of partitioning), NULLs included."""
    out = None
    for name, df in blocks.items():
        rows = F.array_sort(F.collect_list(F.struct(*sorted(df.columns))))
        row = df.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("json")).select(F.lit(name).alias("block"), "json")
        out = row if out is None else out.unionByName(row)
    return out


def from_json_rows(documents: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Typed rows of a JSON document, ``block`` and the union of all blocks' columns. ``blocks`` gives the schemas."""
    out = None
    for name, df in blocks.items():
        schema = "array<struct<" + ", ".join(f"`{c}`:{t}" for c, t in df.select(*sorted(df.columns)).dtypes) + ">>"
        rows = documents.where(F.col("block") == name).select("block", F.inline(F.from_json("json", schema)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def as_document(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """One row, ``document``: a JSON object with a field per block, each the block's rows as a sorted array, NULLs included."""
    rows = as_json_rows(blocks)
    fields = F.transform(F.sort_array(F.collect_list(F.struct("block", "json"))), lambda b: F.concat(F.lit('"'), b["block"], F.lit('":'), b["json"]))
    return rows.agg(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("document"))


def from_document(documents: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Typed rows of nested documents, ``block`` and the union of all blocks' columns. ``blocks`` gives the schemas."""
    kind = ", ".join(f"`{name}`: array<struct<" + ", ".join(f"`{c}`:{t}" for c, t in df.select(*sorted(df.columns)).dtypes) + ">>" for name, df in blocks.items())
    parsed = documents.select(F.from_json("document", f"struct<{kind}>").alias("d"))
    out = None
    for name in blocks:
        rows = parsed.select(F.lit(name).alias("block"), F.inline(F.col("d")[name]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def write_json(documents: DataFrame, path: str) -> str:
    """JSON-lines sink (UTF-8), one line per block; the commit protocol makes it appear whole."""
    documents.write.mode("overwrite").json(path)
    return path


def json_roundtrip(spark: SparkSession, blocks: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Writes the blocks as one nested JSON document and reads it back as typed rows."""
    as_document(blocks).select(F.col("document").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return from_document(spark.read.text(path, wholetext=True).select(F.col("value").alias("document")).where("document <> ''"), blocks)
