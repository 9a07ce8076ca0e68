"""Ensemble report end to end: hybrid priors on the order profile and an
empirical prior on the document profile."""

from conftest import SF01
from plurality.operators import scoring, shares
from plurality.plans import standard as S
from plurality.plans.ensemble_report import ensemble_report, resolve_prior
from plurality.plans.report import as_json_rows
from plurality.sources import profiles
from plurality.spec import Ensemble, Factor, Perspective


def test_hybrid_report_blocks(spark):
    prof = profiles.order_profile(spark, SF01)
    blocks = ensemble_report(spark, prof, S.STANDARD_ENSEMBLE)
    assert {"perspectives", "choices", "winner_assessment", "prior_sensitivity", "prior_verdicts", "choice_ranges"} <= set(blocks)
    cons = {r.choice: r for r in blocks["choices"].collect()}
    assert sum(r["count"] for r in cons.values()) == 15000
    scen = {(r.prior_id, r.choice): r.percent for r in blocks["prior_sensitivity"].collect()}
    assert abs(scen[("central", "alpha")] - cons["alpha"].percent) < 1e-6
    assert len(as_json_rows(blocks).collect()) == len(blocks)


def test_empirical_prior_feeds_scoring(spark):
    docs = profiles.document_profile(spark, SF01)
    ens = Ensemble(
        question="q", choices=S.CHOICES, base_scores=S.CENTRAL,
        perspectives=tuple(Perspective(f"p{i}", "", (Factor("length_band", ("long",), {"alpha": 0.1 * i}),
                                                     Factor("lang", ("en",), {"beta": 0.05}))) for i in range(1, 4)),
        evidence=S.DOCUMENT_EVIDENCE, seed=S.STANDARD_SEED,
    )
    scores, mode, report = resolve_prior(docs, ens)
    assert mode == "empirical_direct" and abs(sum(scores.values()) - 1) < 1e-12
    assert report is not None and report.count() == 3
    blocks = ensemble_report(spark, docs, ens)
    per = {(r.perspective_id, r.choice): r.percent for r in blocks["perspectives"].collect()}
    rule = ens.rule_for(ens.perspectives[0], scores)
    direct = {r.choice: r.percent for r in shares.shares(scoring.probabilities(docs, rule), rule).collect()}
    for c in ens.choice_ids:
        assert abs(per[("p1", c)] - direct[c]) < 1e-6


def test_one_scan_report_equals_separate_operators(spark):
    from plurality.plans.report import rule_report

    prof, rule = profiles.order_profile(spark, SF01), S.STANDARD_RULE
    for mode in ("expected", "sampled"):
        scored = scoring.probabilities(prof, rule, mode=mode)
        a = {
            "choices": shares.apportioned_counts(scored, rule),
            "groups": shares.breakdown(scored, rule, S.ORDER_CATALOG),
            "preference_groups": shares.best_segments(spark, shares.segments(scored, rule, S.ORDER_CATALOG), rule),
            "missing": shares.missing_cells(scored, rule.factor_attributes()),
        }
        b = rule_report(spark, prof, rule, S.ORDER_CATALOG, mode=mode)
        assert set(b) == {*a, "rows", "top_factors"}
        for name in a:
            ra = sorted(tuple(r) for r in a[name].select(*sorted(a[name].columns)).collect())
            rb = sorted(tuple(r) for r in b[name].select(*sorted(b[name].columns)).collect())
            assert ra == rb, (mode, name)


def test_report_factor_coverage_equals_separate_pass(spark):
    from plurality.operators.evidence import coverage

    prof = profiles.order_profile(spark, SF01)
    blocks = ensemble_report(spark, prof, S.STANDARD_ENSEMBLE)
    keys = [(f.attribute, tuple(f.conditions)) for p in S.STANDARD_ENSEMBLE.perspectives for f in p.factors]
    sep = sorted((r.key_index, r.valid, r.matched, r.n) for r in coverage(prof, keys).collect())
    got = sorted((r.key_index, r.valid, r.matched, r.n) for r in blocks["factors"].collect())
    assert got == sep


def test_json_keeps_null_fields(spark, tmp_path):
    from plurality.plans.report import from_json_rows, json_roundtrip

    blocks = {"a": spark.createDataFrame([("x", None), ("y", 2)], "k string, v int"), "b": spark.createDataFrame([(1.5,)], "w double")}
    assert '"v":null' in as_json_rows({"a": blocks["a"]}).first()["json"]
    got = sorted(tuple(r) for r in json_roundtrip(spark, blocks, str(tmp_path / "j")).select("block", "k", "v", "w").collect())
    assert sorted(got, key=str) == sorted([("a", "x", None, None), ("a", "y", 2, None), ("b", None, None, 1.5)], key=str)
    assert from_json_rows(as_json_rows({"a": blocks["a"].limit(0)}), {"a": blocks["a"]}).count() == 0


def test_bad_rules_are_found_and_stop_the_run(spark):
    from plurality.operators.audit import SCHEMAS, audit, audit_tables, flatten, require_valid
    from plurality.spec import Prior, Rule

    rules = {
        "none": Rule("q", (), {}, (), (), ""),
        "shadow": Ensemble("q", S.CHOICES, S.CENTRAL, S.PERSPECTIVES, (Prior("authored", S.CENTRAL), Prior("x", S.CENTRAL), Prior("y", S.CENTRAL)),
                           "authored", "x", ("status",)),
        "twice": Ensemble("q", S.CHOICES, S.CENTRAL, S.PERSPECTIVES, (Prior("x", S.CENTRAL), Prior("x", S.CENTRAL), Prior("y", S.CENTRAL), Prior("z", S.CENTRAL)),
                          "y", "z", ("status",)),
        "empty": Ensemble.from_dict({"question": "q", "choices": [{"id": "a"}, {"id": "b"}], "base_scores": {"a": 0.5, "b": 0.5},
                                     "hybrid_sensitivity": {"priors": []}}),
    }
    found = {(r.rule_id, r.check) for r in audit(spark, rules, S.ORDER_CATALOG).collect()}
    assert ("none", "A1 choice_count") in found
    assert not [c for r, c in found if r == "shadow" and c in ("A2 prior_sum", "A10 prior_count", "A10 fit_only_missing", "A10 central_missing")]
    assert ("twice", "A10 duplicate_prior") in found and ("empty", "A10 prior_count") in found
    tables = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in flatten(rules).items()}
    assert {(r.rule_id, r.check) for r in audit_tables(spark, tables, S.ORDER_CATALOG).collect()} == found
    require_valid(spark, {"ok": S.STANDARD_RULE}, S.ORDER_CATALOG)
    try:
        require_valid(spark, rules, S.ORDER_CATALOG)
    except ValueError as error:
        assert "A1 choice_count" in str(error)
    else:
        raise AssertionError("nothing raised")
