"""Ensemble report: prior resolution, one scenario scan, and every block of
the ensemble result document (E1-E12, G10-G13).

Scans: one for the whole grid (every perspective x prior x choice sum, the
factor coverage counts and, with a catalog, all segments and missing cells,
folded into one aggregate), and one more only for an empirical prior. Each one-row aggregate is checkpointed into the
shared folder and every block is derived from it, so no block rescans.
Prior resolution is the only driver boundary: an empirical prior is one
aggregate row of at most four ratios, turned into literals for the scoring
expressions (the same barrier the reference has).
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators import ensemble as E
from plurality.operators.audit import require_sound
from plurality.operators.evidence import (
    coverage_aggs, coverage_rows, empirical_prior, evidence_counts, evidence_report,
)
from plurality.operators.scoring import KEY
from plurality.operators.shares import factor_effects
from plurality.session import shared_dir
from plurality.spec import Catalog, Ensemble


def resolve_prior(df: DataFrame, ens: Ensemble) -> tuple[Mapping[str, float], str, DataFrame | None]:
    """(scores, mode, evidence report). Hybrid: the central prior. Empirical
    evidence: matched shares (authored when nothing matched). Otherwise the
    authored prior."""
    if ens.priors and ens.central_prior_id is not None:
        return dict(ens.central_scores()), "hybrid_sensitivity", None
    if ens.evidence is None:
        return dict(ens.base_scores), "authored", None
    shared_dir(df.sparkSession)
    df = df.where(F.col(KEY).isNotNull())  # the same rows as every share of the document
    counts = evidence_counts(df, ens.evidence, ens.choice_ids).checkpoint(eager=True)  # one scan, one row
    prior = empirical_prior(df, ens.evidence, ens.choice_ids, ens.base_scores, counts=counts)
    rows = prior.collect()  # one row per choice (<= 4)
    scores = {r["choice"]: float(r["prior"]) for r in rows}
    mode = "empirical_direct" if rows and rows[0]["source"] == "empirical" else "authored"
    return scores, mode, evidence_report(df, ens.evidence, ens.choice_ids, counts=counts)


def ensemble_report(spark: SparkSession, df: DataFrame, ens: Ensemble, digits: int = 6, catalog: Catalog | None = None,
                    mode: str = "expected") -> dict[str, DataFrame]:
    """The document's blocks. With a catalog also each perspective's best
    segments and missing cells, from the same pass (``perspective_cube``)."""
    if catalog is not None:
        require_sound(ens, catalog)
    scores, source, evidence = resolve_prior(df, ens)
    central_id = ens.central_prior_id or "central"
    priors = [(p.id, p.base_scores) for p in ens.priors] if ens.priors else [(central_id, scores)]
    if all(pid != central_id for pid, _ in priors):
        priors = [(central_id, scores), *priors]
    factors = E.ensemble_factors(ens)
    keys = [(f.attribute, tuple(f.conditions)) for _, _, f in factors]
    fold = coverage_aggs(keys, where=F.col(KEY).isNotNull())[1:]  # the grid already counts n
    shared_dir(spark)
    cells = None
    if catalog is None:
        agg, names = E.scenario_aggregate(df, ens, priors, extra_aggs=fold, keep=[a for a, _ in keys], mode=mode)
        agg = agg.checkpoint(eager=True)  # the one scan of the grid
    else:
        cells, names = E.perspective_cube(df, ens, catalog, priors, mode=mode, extra=fold)
        cells = cells.checkpoint(eager=True)  # the one scan of the grid
        agg = E.cube_scenarios(cells, names, [f"{kind}{k}" for k in range(len(keys)) for kind in ("valid", "matched")])
    sums = E.scenario_long(agg, names)
    shares = E.perspective_shares(sums, central_id, digits)
    win = E.winners(shares)
    found = E.directions(factor_effects(spark, factors, ens.choice_ids))
    extra = [[("perspective_id", o), ("factor_position", p)] for o, p, _ in factors]
    observed = coverage_rows(agg, keys, digits, extra=extra).drop("attribute", "conditions")
    blocks = {
        "rows": agg.select((F.col("n") + F.col("n_null_key")).alias("n_rows"), F.col("n").alias("n_scored"), "n_null_key"),
        "prior": spark.createDataFrame([(c, float(v), source) for c, v in scores.items()], "choice string, prior double, mode string"),
        "perspectives": shares,
        "winners": win,
        "choices": E.consensus_table(shares, ens.choice_ids, digits),
        "winner_assessment": E.stability(win, len(ens.perspectives)),
        "factors": found.withColumnRenamed("owner", "perspective_id").drop("condition_set").join(observed, ["perspective_id", "factor_position"]),
        "robust_signals": E.robust_signals(found, [p.id for p in ens.perspectives]),
    }
    if cells is not None:
        central = next(h for h, (pid, _) in enumerate(priors) if pid == central_id)
        blocks["preference_groups"] = E.perspective_best_segments(spark, cells, ens, catalog, digits, prior=central)
        blocks["missing"] = E.perspective_missing_cells(cells, ens)
    if evidence is not None:
        blocks["prior_evidence"] = evidence
    if ens.priors:
        scen = E.prior_scenarios(sums, digits)
        blocks["prior_sensitivity"] = scen
        blocks["prior_verdicts"] = E.prior_verdicts(scen, digits)
        blocks["choice_ranges"] = E.prior_ranges(scen)
    return blocks
