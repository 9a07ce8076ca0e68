"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the test tables through a profile builder and runs one
operator (or a small composition) with the standard parameters.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators import scoring, shares
from plurality.plans import standard as S
from plurality.session import scratch_path, shared_dir
from plurality.sources import profiles

DIGITS = 6       # share / percent rounding (portable between engines)
ROW_DIGITS = 9   # per-row probability rounding

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.order_profile(spark, sf_dir)


def share_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.probabilities(_orders(spark, sf_dir), S.STANDARD_RULE)
    return shares.shares(scored, S.STANDARD_RULE, DIGITS)


def share_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.probabilities(_orders(spark, sf_dir), S.STANDARD_RULE, mode="sampled")
    return shares.shares(scored, S.STANDARD_RULE, DIGITS)


def hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed uniforms per unit: one per choice and the sampled-mode draw, plus
    the exact unsigned 64-bit hash of the draw."""
    from plurality.functions.hashing import keyed_text, lo64_hex, uniform_of_digest

    rule = S.STANDARD_RULE
    key = F.col("unit_id")
    suffixes = [*rule.choice_ids, "sample"]
    digests = _orders(spark, sf_dir).select(
        "unit_id", *[F.md5(keyed_text(rule.seed, key, sfx)).alias(f"_d_{sfx}") for sfx in suffixes]
    )
    return digests.select(
        "unit_id", *[uniform_of_digest(F.col(f"_d_{sfx}")).alias(f"u_{sfx}") for sfx in suffixes],
        F.conv(lo64_hex(F.col("_d_sample")), 16, 10).alias("h_sample"),
    )


def _rounded(df: DataFrame, prefix: str, rule, digits: int) -> DataFrame:
    return df.select("unit_id", *[F.round(f"{prefix}{i}", digits).alias(f"{prefix}_{c}") for i, c in enumerate(rule.choice_ids)])


def score_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.score(_orders(spark, sf_dir), S.STANDARD_RULE, keep=[]), "s", S.STANDARD_RULE, ROW_DIGITS)


def score_logits_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = S.STANDARD_RULE
    ft = scoring.factor_table(spark, rule)
    return _rounded(scoring.score_by_join(_orders(spark, sf_dir), rule, ft), "s", rule, ROW_DIGITS)


def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = S.STANDARD_RULE
    return _rounded(scoring.probabilities(_orders(spark, sf_dir), rule, keep=[]), "p", rule, ROW_DIGITS)


def apportion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.probabilities(_orders(spark, sf_dir), S.STANDARD_RULE)
    return shares.apportioned_counts(scored, S.STANDARD_RULE, DIGITS)


def breakdown_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.probabilities(_orders(spark, sf_dir), S.STANDARD_RULE)
    return shares.breakdown(scored, S.STANDARD_RULE, S.ORDER_CATALOG, digits=DIGITS)


def _segments(spark: SparkSession, sf_dir: str, *arities: int) -> DataFrame:
    scored = scoring.probabilities(_orders(spark, sf_dir), S.STANDARD_RULE)
    return shares.segments(scored, S.STANDARD_RULE, S.ORDER_CATALOG, digits=DIGITS, arities=arities)


def segments_1way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, 1).drop("attr_2", "value_2")


def segments_2way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, 2)


def best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.best_segments(spark, _segments(spark, sf_dir, 1, 2), S.STANDARD_RULE)


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.probabilities(_orders(spark, sf_dir), S.STANDARD_RULE)
    return shares.missing_cells(scored, S.STANDARD_RULE.factor_attributes())


def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest factors of the rule with their observed coverage."""
    from plurality.operators.evidence import coverage

    rule = S.STANDARD_RULE
    effects = shares.factor_effects(spark, [("", p, f) for p, f in enumerate(rule.factors)], rule.choice_ids)
    cov = coverage(_orders(spark, sf_dir), [(f.attribute, tuple(f.conditions)) for f in rule.factors], DIGITS)
    cov = cov.select(F.col("key_index").alias("factor_position"), "n", "valid", "matched", "matched_pct_all")
    return shares.top_factors(effects).join(cov, "factor_position").select(
        "rank", "factor_position", "attribute", "conditions", "max_abs_effect", "n", "valid", "matched", "matched_pct_all")


def row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares over documents of which some have no key: all rows, the scored ones and those with a NULL key."""
    scored = scoring.probabilities(profiles.keyed_documents(spark, sf_dir), S.DOCUMENT_RULE, null_keys=True)
    return shares.shares_with_counts(scored, S.DOCUMENT_RULE, digits=DIGITS)


def score_rules_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of several stored rules over all orders, effects from their factor table."""
    out = scoring.score_rules(_orders(spark, sf_dir), S.STORED_RULES)
    return out.withColumn("score", F.round("score", ROW_DIGITS))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.document_profile(spark, sf_dir)


def prior_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.evidence import evidence_report

    return evidence_report(_documents(spark, sf_dir), S.DOCUMENT_EVIDENCE, S.STANDARD_RULE.choice_ids, DIGITS)


def prior_empirical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.evidence import empirical_prior

    return empirical_prior(_documents(spark, sf_dir), S.DOCUMENT_EVIDENCE, S.STANDARD_RULE.choice_ids, S.CENTRAL)


def factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.evidence import coverage, coverage_keys

    return coverage(_documents(spark, sf_dir), coverage_keys(S.DOCUMENT_FACTORS), DIGITS)


def _scenario_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import scenario_sums

    return scenario_sums(_orders(spark, sf_dir), S.STANDARD_ENSEMBLE)


def _perspective_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perspective shares under the central prior only (one scan)."""
    from plurality.operators.ensemble import perspective_shares, scenario_sums

    ens = S.STANDARD_ENSEMBLE
    priors = [(ens.central_prior_id, ens.central_scores())]
    return perspective_shares(scenario_sums(_orders(spark, sf_dir), ens, priors), ens.central_prior_id, DIGITS)


def ensemble_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perspective_shares(spark, sf_dir)


def ensemble_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import winners

    return winners(_perspective_shares(spark, sf_dir))


def ensemble_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import consensus_table

    return consensus_table(_perspective_shares(spark, sf_dir), S.STANDARD_ENSEMBLE.choice_ids, DIGITS)


def ensemble_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import stability, winners

    return stability(winners(_perspective_shares(spark, sf_dir)), len(S.STANDARD_ENSEMBLE.perspectives))


def prior_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import prior_scenarios

    return prior_scenarios(_scenario_sums(spark, sf_dir), DIGITS)


def prior_sensitivity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import prior_scenarios, prior_verdicts

    return prior_verdicts(prior_scenarios(_scenario_sums(spark, sf_dir), DIGITS), DIGITS)


def prior_sensitivity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import prior_ranges, prior_scenarios

    return prior_ranges(prior_scenarios(_scenario_sums(spark, sf_dir), DIGITS))


def ensemble_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perspective shares in sampled mode: one draw per order, the same for every perspective."""
    from plurality.operators.ensemble import perspective_shares, scenario_sums

    ens = S.STANDARD_ENSEMBLE
    priors = [(ens.central_prior_id, ens.central_scores())]
    return perspective_shares(scenario_sums(_orders(spark, sf_dir), ens, priors, mode="sampled"), ens.central_prior_id, DIGITS)


def ensemble_best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import perspective_best_segments, perspective_cube

    shared_dir(spark)
    cells = perspective_cube(_orders(spark, sf_dir), S.STANDARD_ENSEMBLE, S.ORDER_CATALOG)[0].checkpoint(eager=True)
    return perspective_best_segments(spark, cells, S.STANDARD_ENSEMBLE, S.ORDER_CATALOG, DIGITS)


def ensemble_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.ensemble import perspective_cube, perspective_missing_cells

    return perspective_missing_cells(perspective_cube(_orders(spark, sf_dir), S.STANDARD_ENSEMBLE, S.ORDER_CATALOG)[0], S.STANDARD_ENSEMBLE)


def factor_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of every perspective factor, with its observed coverage."""
    from plurality.operators import ensemble as E
    from plurality.operators.evidence import coverage

    ens = S.STANDARD_ENSEMBLE
    factors = E.ensemble_factors(ens)
    found = E.directions(shares.factor_effects(spark, factors, ens.choice_ids))
    extra = [[("perspective_id", o), ("factor_position", p)] for o, p, _ in factors]
    cov = coverage(_orders(spark, sf_dir), [(f.attribute, tuple(f.conditions)) for _, _, f in factors], DIGITS, extra=extra)
    cov = cov.select("perspective_id", "factor_position", "valid", "matched", "matched_pct_valid")
    return found.withColumnRenamed("owner", "perspective_id").join(cov, ["perspective_id", "factor_position"]).select(
        "perspective_id", "factor_position", "attribute", "conditions", "direction", "valid", "matched", "matched_pct_valid")


def robust_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals backed by two or more perspectives, with observed coverage."""
    from plurality.operators import ensemble as E
    from plurality.operators.evidence import coverage

    ens = S.STANDARD_ENSEMBLE
    factors = E.ensemble_factors(ens)
    found = E.robust_signals(E.directions(shares.factor_effects(spark, factors, ens.choice_ids)), [p.id for p in ens.perspectives])
    keys = list(dict.fromkeys((f.attribute, tuple(sorted(set(f.conditions)))) for _, _, f in factors))
    cov = coverage(_orders(spark, sf_dir), keys, DIGITS).select("attribute", "conditions", "valid", "matched")
    return found.join(cov, ["attribute", "conditions"]).select(
        "attribute", "conditions", "supports", "perspective_count", "perspectives", "valid", "matched")


PACKED_FIELDS = profiles.packed_dictionary(32)


def decode_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.packed import decode_wide

    return decode_wide(profiles.packed_profile(spark, sf_dir), PACKED_FIELDS)


def decode_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the fields, read straight from their bytes."""
    from plurality.operators.packed import decode_fields

    return decode_fields(profiles.packed_profile(spark, sf_dir), PACKED_FIELDS, [PACKED_FIELDS[i][0] for i in (3, 9, 30)])


def decode_dirty_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override lists with NULL entries and entries without a field index, which are passed over."""
    from plurality.operators.packed import decode_wide

    junk = F.expr("array(NULL, named_struct('field_index', CAST(NULL AS INT), 'value', 'lost'))")
    packed = profiles.packed_profile(spark, sf_dir)
    lists = F.coalesce("attribute_overrides", F.array().cast(packed.schema["attribute_overrides"].dataType))
    dirty = packed.withColumn("attribute_overrides", F.when(F.col("source_row_index") % 2 == 0, F.concat(junk, lists)).otherwise(F.col("attribute_overrides")))
    return decode_wide(dirty, PACKED_FIELDS)


def decode_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.packed import effective_overrides

    return effective_overrides(profiles.packed_profile(spark, sf_dir), PACKED_FIELDS)


def decode_long_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.packed import decode_long

    return decode_long(spark, profiles.packed_profile(spark, sf_dir), PACKED_FIELDS)


def packed_length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.packed import length_audit

    return length_audit(profiles.packed_profile(spark, sf_dir), len(PACKED_FIELDS))


def scan_union_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the text-bearing shards (different schemas merged by name):
    rows, non-NULL texts and characters per file."""
    from plurality.sources.files import scan_union

    d = sf_dir.rstrip("/")
    df = scan_union(spark, [f"{d}/documents.parquet", f"{d}/benchmark.parquet"], merge_schema=True)
    return df.groupBy(F.regexp_extract("file_path", r"([^/]+\.parquet)", 1).alias("file_name")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("texts"),
        F.sum(F.length("text")).cast("bigint").alias("chars"), F.count("doc_id").alias("with_doc_id"),
        F.count("item_id").alias("with_item_id"),
    )


def describe_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.sources.files import describe

    return describe(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")


def sink_roundtrip_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order profile written as ZSTD Parquet to the shared folder and read
    back; the rows must equal the profile."""
    from plurality.sources.files import sink_roundtrip

    back, _ = sink_roundtrip(spark, _orders(spark, sf_dir), "order-profile")
    return back


def sink_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load summary of the written profile: rows, attributes, format, compression."""
    from plurality.sources.files import sink_roundtrip

    return sink_roundtrip(spark, _orders(spark, sf_dir), "order-profile")[1].drop("path")


def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (length and SHA-256 of the html) against a manifest with planted
    faults: wrong sizes, wrong hashes, entries without a page, pages without an
    entry."""
    from plurality.sources.files import record_manifest_audit

    pages = profiles.table(spark, sf_dir, "pages", "page_id BIGINT, html STRING")
    size, digest = F.octet_length("html").cast("bigint"), F.sha2("html", 256)
    records = pages.select(F.col("page_id").alias("name"), size.alias("bytes"), digest.alias("sha256"))
    fault = F.col("page_id") % 10
    listed = pages.where(fault != 3).select(
        F.col("page_id").alias("name"), F.when(fault == 1, size + 1).otherwise(size).alias("bytes"),
        F.when(fault == 2, F.sha2(F.concat("html", F.lit("!")), 256)).otherwise(digest).alias("sha256"))
    gone = pages.where("page_id % 50 = 0").select((F.col("page_id") + 1000000000).alias("name"), F.lit(7).cast("bigint").alias("bytes"),
                                                  F.sha2(F.lit("gone"), 256).alias("sha256"))
    return record_manifest_audit(listed.unionByName(gone), records)


def schema_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.sources.files import schema_readiness as ready

    return ready(_orders(spark, sf_dir), S.ORDER_CATALOG)


def dictionary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.sources.files import observed_dictionary

    return observed_dictionary(_orders(spark, sf_dir), S.ORDER_CATALOG)


def seed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised-text fingerprint (lower case, collapsed whitespace, SHA-256)
    of every document."""
    from plurality.functions.text import fingerprint

    docs = profiles.table(spark, sf_dir, "documents", "doc_id BIGINT, text STRING")
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


SYNTHETIC_ATTRIBUTES = {"color": ["r", "g", "b", "k", "w"], "size": ["S", "M", "L"], "tier": ["gold", "silver", "bronze", "basic"]}


def synthetic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-assigned attributes for demo keys ``demo-<orderkey>``."""
    keys = profiles.table(spark, sf_dir, "orders", "o_orderkey BIGINT").select(
        F.concat(F.lit("demo-"), F.col("o_orderkey").cast("string")).alias("unit_id")
    )
    return profiles.synthetic_profile(keys, SYNTHETIC_ATTRIBUTES)


def _schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.dictionary import schema_fields

    d = sf_dir.rstrip("/")
    return schema_fields(spark, [(t, f"{d}/{t}.parquet") for t in S.SCHEMA_TABLES])


def classify_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the test tables classified into a catalog domain."""
    from plurality.operators.dictionary import classify

    return classify(_schema_fields(spark, sf_dir), S.TESTDATA_CLASSIFIER)


def classify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plurality.operators.dictionary import classify, domain_index

    clf = S.TESTDATA_CLASSIFIER
    return domain_index(spark, classify(_schema_fields(spark, sf_dir), clf), clf)


def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audit findings of the stored rules, including condition values that
    never occur in the order profile."""
    from plurality.operators.audit import audit

    return audit(spark, S.AUDIT_RULES, S.ORDER_CATALOG, profile=_orders(spark, sf_dir),
                 sensitive_pattern=S.TESTDATA_CLASSIFIER.sensitive_pattern)


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard rule's report: written as JSON, read back as typed rows."""
    from plurality.plans.report import json_roundtrip, rule_report

    blocks = rule_report(spark, _orders(spark, sf_dir), S.STANDARD_RULE, S.ORDER_CATALOG, digits=DIGITS)
    return json_roundtrip(spark, blocks, scratch_path(spark, "result-json"))


def ensemble_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard ensemble's document (hybrid priors): written as JSON, read back as typed rows."""
    from plurality.plans.ensemble_report import ensemble_report
    from plurality.plans.report import json_roundtrip

    blocks = ensemble_report(spark, _orders(spark, sf_dir), S.STANDARD_ENSEMBLE, DIGITS, S.ORDER_CATALOG)
    return json_roundtrip(spark, blocks, scratch_path(spark, "ensemble-json"))


def decode_wide_513(spark: SparkSession, sf_dir: str) -> DataFrame:
    """513 of 1,290 fields of 645-byte rows, in batches."""
    from plurality.operators.packed import decode_batches

    return decode_batches(profiles.wide_packed_profile(spark, sf_dir), profiles.packed_dictionary(profiles.WIDE_FIELDS), profiles.wide_selection())


#: pages of a file and bytes of a block in the file checks
PAGES_PER_FILE, FILE_BLOCK = 32, 4096


def _page_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """A manifest of files of pages (with block digests), and the folder they
    were written to: some with a changed byte, cut short, not written, or not
    in the manifest (by file number modulo 7)."""
    from plurality.sources.integrity import write_files

    pages = profiles.table(spark, sf_dir, "pages", "page_id BIGINT, html STRING")
    in_order = F.sort_array(F.collect_list(F.struct("page_id", F.coalesce("html", F.lit("")).alias("html"))))
    files = pages.groupBy(F.expr(f"page_id div {PAGES_PER_FILE}").alias("number")).agg(in_order.alias("all"))
    files = files.select("number", F.concat(F.lit("pages-"), F.col("number").cast("string"), F.lit(".bin")).alias("file_name"),
                         F.encode(F.array_join(F.transform("all", lambda p: p["html"]), ""), "UTF-8").alias("content"))
    size, fault = F.octet_length("content"), F.col("number") % 7
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / FILE_BLOCK).cast("int") - 1, F.lit(0))),
                         lambda k: F.sha2(F.substring(F.col("content"), k * FILE_BLOCK + 1, F.lit(FILE_BLOCK)), 256))
    manifest = files.where(fault != 4).select("file_name", size.cast("bigint").alias("bytes"), blocks.alias("blocks"))
    half = F.floor(size / 2).cast("int")
    changed = F.concat(F.substring("content", F.lit(1), half), F.unhex(F.lit("00")), F.substring("content", half + 2, size))
    short = F.substring("content", F.lit(1), F.greatest(size - 5, F.lit(0)))
    written = files.where(fault != 3).select("file_name", F.when(fault == 1, changed).when(fault == 2, short).otherwise(F.col("content")).alias("content"))
    folder = scratch_path(spark, "page-files")
    write_files(written, folder).write.format("noop").mode("overwrite").save()
    return manifest, folder


def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written files against their manifest, block by block, all faults with the blocks that differ."""
    from plurality.sources.integrity import audit_files

    manifest, folder = _page_files(spark, sf_dir)
    found = audit_files(spark, manifest, folder, "pages-*.bin", FILE_BLOCK)
    return found.withColumn("bad_blocks", F.array_join("bad_blocks", ","))


def file_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by existence and size only."""
    from plurality.sources.integrity import completeness, listed_files

    manifest, folder = _page_files(spark, sf_dir)
    return completeness(manifest, listed_files(spark, folder, "pages-*.bin"))


def _catalog_values(spark: SparkSession, sf_dir: str, domains) -> DataFrame:
    """(domain, attribute, value) of the distinct values of table columns."""
    out = None
    for domain, table, columns in domains:
        df = profiles.table(spark, sf_dir, table).select(*columns)
        pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
        rows = df.select(F.lit(domain).alias("domain"), F.inline(pairs)).where("value IS NOT NULL").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of the tables' values, written as JSON files and loaded with the duplicate check."""
    from plurality.sources.catalogs import load_catalog, write_catalog

    index = write_catalog(_catalog_values(spark, sf_dir, S.CATALOG_DOMAINS), scratch_path(spark, "catalog"))
    return load_catalog(spark, index, breakdowns=S.CATALOG_BREAKDOWNS, non_segment=S.CATALOG_NON_SEGMENT)


def catalog_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that two domains of a written catalog declare."""
    from plurality.sources.catalogs import duplicate_attributes, read_catalog, write_catalog

    domains = [*S.CATALOG_DOMAINS, *S.CATALOG_REPEATED]
    return duplicate_attributes(read_catalog(spark, write_catalog(_catalog_values(spark, sf_dir, domains), scratch_path(spark, "catalog"))))


def unicode_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds (NFKC, case folding, single blanks, SHA-256) of all documents, with planted forms in front of three in four."""
    from plurality.functions.text import seed_text

    docs = profiles.table(spark, sf_dir, "documents", "doc_id BIGINT, text STRING")
    front = F.get(F.array(*[F.lit(p) for p in S.PLANTED_FORMS]), (F.col("doc_id") % len(S.PLANTED_FORMS)).cast("int"))
    return docs.select("doc_id", seed_text(F.concat(front, F.col("text"))).alias("seed"))


def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt host names (a letter left out, changed, or the name reversed) and the closest known one."""
    from plurality.operators.names import closest

    host = F.regexp_extract("url", r"://([a-z]+)\.", 1)
    pages = profiles.table(spark, sf_dir, "pages", "page_id BIGINT, url STRING").select("page_id", host.alias("known"))
    at = (F.col("page_id") % 4 + 2).cast("int")
    front, back = F.substring("known", F.lit(1), at - 1), F.substring("known", at + 1, F.length("known"))
    wrong = F.when(F.col("page_id") % 3 == 0, F.concat(front, back)).when(F.col("page_id") % 3 == 1, F.concat(front, F.lit("q"), back)).otherwise(F.reverse("known"))
    known = pages.select("known")
    unknown = pages.select(wrong.alias("unknown")).join(known.withColumnRenamed("known", "unknown"), "unknown", "left_anti")
    return closest(unknown, known).withColumn("ratio", F.round("ratio", ROW_DIGITS))


def row_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all order lines (a row per unit of quantity) written as Parquet; the row groups as their footers tell."""
    from plurality.sources.files import row_group_audit, row_groups, write_parquet

    lines = profiles.table(spark, sf_dir, "lineitem", "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE")
    units = lines.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int"))).alias("unit"))
    path = write_parquet(units, scratch_path(spark, "units"))
    return row_group_audit(row_groups(spark, path)).drop("row_groups")


def stored_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored rule or ensemble per order, with planted faults of every kind, audited in one job."""
    from plurality.operators.audit import audit_stored
    from plurality.plans.stored_rules import stored_rules

    orders = profiles.table(spark, sf_dir, "orders", "o_orderkey BIGINT")
    return audit_stored(spark, stored_rules(orders), S.ORDER_CATALOG, _orders(spark, sf_dir), S.TESTDATA_CLASSIFIER.sensitive_pattern)


REGISTRY: dict[str, Query] = {
    "share_expected": share_expected,
    "share_sampled": share_sampled,
    "hash_uniform": hash_uniform,
    "score_logits": score_logits,
    "score_logits_join": score_logits_join,
    "softmax_probs": softmax_probs,
    "apportion_counts": apportion_counts,
    "breakdown_unknown": breakdown_unknown,
    "segments_1way": segments_1way,
    "segments_2way": segments_2way,
    "best_segment": best_segment,
    "missing_cells": missing_cells,
    "top_factors": top_factors,
    "prior_evidence": prior_evidence,
    "prior_empirical": prior_empirical,
    "factor_coverage": factor_coverage,
    "ensemble_perspectives": ensemble_perspectives,
    "ensemble_winners": ensemble_winners,
    "ensemble_consensus": ensemble_consensus,
    "ensemble_stability": ensemble_stability,
    "prior_sensitivity": prior_sensitivity,
    "prior_sensitivity_verdict": prior_sensitivity_verdict,
    "prior_sensitivity_range": prior_sensitivity_range,
    "ensemble_sampled": ensemble_sampled,
    "ensemble_best_segments": ensemble_best_segments,
    "ensemble_missing_cells": ensemble_missing_cells,
    "row_accounting": row_accounting,
    "score_rules_join": score_rules_join,
    "decode_subset": decode_subset,
    "decode_dirty_overrides": decode_dirty_overrides,
    "factor_direction": factor_direction,
    "robust_signals": robust_signals,
    "decode_packed": decode_packed,
    "decode_overrides": decode_overrides,
    "decode_long_join": decode_long_join,
    "packed_length_audit": packed_length_audit,
    "scan_union_parquet": scan_union_parquet,
    "describe_dataset": describe_dataset,
    "sink_roundtrip_zstd": sink_roundtrip_zstd,
    "sink_load_summary": sink_load_summary,
    "manifest_audit": manifest_audit,
    "schema_readiness": schema_readiness,
    "dictionary_long": dictionary_long,
    "seed_column": seed_column,
    "synthetic_profile": synthetic_profile,
    "classify_fields": classify_fields,
    "classify_index": classify_index,
    "rule_audit": rule_audit,
    "result_json": result_json,
    "ensemble_json": ensemble_json,
    "decode_wide_513": decode_wide_513,
    "file_integrity": file_integrity,
    "file_completeness": file_completeness,
    "catalog_load": catalog_load,
    "catalog_duplicates": catalog_duplicates,
    "unicode_seed": unicode_seed,
    "closest_names": closest_names,
    "row_group_sizes": row_group_sizes,
    "stored_rule_audit": stored_rule_audit,
}
