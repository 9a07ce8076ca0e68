"""Field classification into catalog domains.

Input: an encoding schema as a DataFrame ``(field_index, id, label,
category)``. A field is dropped when its id matches the sensitive pattern;
otherwise the first rule that applies assigns its domain: core ids, extra ids
per domain, the first domain (declared order) whose category set holds the
field's category, then a pattern searched in ``id + ' ' + label``. Among
classified fields the first occurrence of an id wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.session import bounded_broadcast


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]                      # declared order; all appear in the index
    sensitive_pattern: str                        # case-insensitive search on the id
    core_domain: str
    core_ids: frozenset[str]
    extra_ids: tuple[tuple[str, frozenset[str]], ...] = ()
    category_domains: tuple[tuple[str, frozenset[str]], ...] = ()
    fallback_pattern: str | None = None           # case-insensitive search on id + ' ' + label
    fallback_domain: str | None = None
    descriptions: dict = field(default_factory=dict)


# The persona-schema classification (id sets, category sets in
# declared order, and the two search patterns).
PERSONA_CLASSIFIER = Classifier(
    domains=("core", "decision-values", "food", "lifestyle-hobbies", "culture-media", "sports-outdoors", "consumer-adventure"),
    sensitive_pattern=r"gender|race|ethnic|relig|politic|sexual|neurotype|disab|diagnos|disease|mental_health",
    core_domain="core",
    core_ids=frozenset({
        "age_bracket", "region", "urbanicity", "socioeconomic_band", "highest_education",
        "life_stage", "tech_savviness", "dominant_trait", "risk_tolerance", "decision_style",
        "values_priority", "economic_motivation", "media_diet",
    }),
    extra_ids=(("food", frozenset({
        "skill_cooking", "skill_baking", "topic_cooking", "topic_wine", "topic_coffee", "topic_tea",
        "topic_baking", "lstyle_diet_type", "lstyle_cooking_freq", "lstyle_coffee_ritual",
        "hob_bread_baking", "hob_home_brewing", "hob_winemaking", "hob_cheesemaking",
    })),),
    category_domains=(
        ("decision-values", frozenset({"Risk & Decision", "Values & Motivation", "Personality: Character",
                                       "Personality: Big Five", "Behavior: Preferences"})),
        ("food", frozenset({"Interests: Food"})),
        ("lifestyle-hobbies", frozenset({"Behavior: Habits", "Interests: Hobbies", "Health: Lifestyle"})),
        ("culture-media", frozenset({"Interests: Culture", "Interests: Media"})),
        ("sports-outdoors", frozenset({"Interests: Sports", "Health: Fitness"})),
    ),
    fallback_pattern=r"travel|shopping|purchase|price|brand|fashion|transport|commut|home_|device|outdoor|environment",
    fallback_domain="consumer-adventure",
)


def classify(fields: DataFrame, clf: Classifier) -> DataFrame:
    """``field_index, id, label, category, domain, reason``; domain NULL for
    dropped fields (reason: sensitive, unmatched, duplicate)."""
    fid, label, cat = F.col("id"), F.col("label"), F.col("category")
    domain = F.when(fid.isin(*sorted(clf.core_ids)), F.lit(clf.core_domain))
    reason = F.when(fid.isin(*sorted(clf.core_ids)), F.lit("core_id"))
    for dom, ids in clf.extra_ids:
        domain = domain.when(fid.isin(*sorted(ids)), F.lit(dom))
        reason = reason.when(fid.isin(*sorted(ids)), F.lit("extra_id"))
    for dom, cats in clf.category_domains:
        domain = domain.when(cat.isin(*sorted(cats)), F.lit(dom))
        reason = reason.when(cat.isin(*sorted(cats)), F.lit("category"))
    if clf.fallback_pattern:
        hit = F.concat_ws(" ", fid, label).rlike("(?i)" + clf.fallback_pattern)
        domain = domain.when(hit, F.lit(clf.fallback_domain))
        reason = reason.when(hit, F.lit("pattern"))
    sensitive = fid.rlike("(?i)" + clf.sensitive_pattern)
    staged = fields.select(
        "field_index", "id", "label", "category",
        F.when(sensitive, F.lit(None).cast("string")).otherwise(domain).alias("_domain"),
        F.when(sensitive, F.lit("sensitive")).otherwise(F.coalesce(reason, F.lit("unmatched"))).alias("_reason"),
    )
    # first classified occurrence of an id wins (the schema is small: a window is fine)
    w = Window.partitionBy("id", F.col("_domain").isNotNull()).orderBy("field_index")
    ranked = staged.withColumn("_rk", F.row_number().over(w))
    dup = F.col("_domain").isNotNull() & (F.col("_rk") > 1)
    return ranked.select(
        "field_index", "id", "label", "category",
        F.when(dup, F.lit(None).cast("string")).otherwise(F.col("_domain")).alias("domain"),
        F.when(dup, F.lit("duplicate")).otherwise(F.col("_reason")).alias("reason"),
    )


def domain_index(spark: SparkSession, classified: DataFrame, clf: Classifier) -> DataFrame:
    """Attribute count per declared domain, zero included."""
    declared = spark.createDataFrame([(i, d) for i, d in enumerate(clf.domains)], "domain_order int, domain string")
    counts = classified.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count(F.lit(1)).alias("attribute_count"))
    return bounded_broadcast(declared, len(clf.domains)).join(counts, "domain", "left").select(
        "domain_order", "domain", F.coalesce(F.col("attribute_count"), F.lit(0).cast("bigint")).alias("attribute_count")
    )


def schema_fields(spark: SparkSession, tables: list[tuple[str, str]]) -> DataFrame:
    """Encoding-schema frame from Parquet footers: one field per column, in
    table then column order; label ``table.column``, category = table."""
    rows = []
    for name, path in tables:
        for f in spark.read.parquet(path).schema.fields:
            rows.append((len(rows), f.name, f"{name}.{f.name}", name))
    return spark.createDataFrame(rows, "field_index int, id string, label string, category string").coalesce(1)
