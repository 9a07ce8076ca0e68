"""Rule and ensemble documents to specs."""

import hashlib

from plurality.spec import Ensemble, Rule


def test_rule_from_dict():
    doc = {
        "question": "  Which   PLAN? ",
        "choices": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}],
        "base_scores": {"a": 0.6, "b": 0.4},
        "factors": [{"attribute": "region", "conditions": ["ASIA"], "effects": {"a": 0.1}, "reason": "r"}],
        "result_groups": ["region"],
    }
    r = Rule.from_dict(doc)
    assert r.choice_ids == ["a", "b"] and r.factors[0].effect("a") == 0.1 and r.factors[0].effect("b") == 0.0
    assert r.seed == hashlib.sha256(b"which plan?").hexdigest()
    assert Rule.from_dict({**doc, "seed": "x"}).seed == hashlib.sha256(b"x").hexdigest()
    assert Rule.from_dict({k: v for k, v in doc.items() if k != "result_groups"}).result_groups == ("region", "age_bracket")


def test_ensemble_from_dict_hybrid_and_empirical():
    base = {
        "question": "q", "choices": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}], "base_scores": {"a": 0.5, "b": 0.5},
        "perspectives": [{"id": f"p{i}", "label": "", "rationale": "", "factors": [
            {"attribute": "x", "conditions": ["1"], "effects": {"a": 0.1}, "reason": ""}]} for i in range(3)],
    }
    hyb = Ensemble.from_dict({**base, "hybrid_sensitivity": {
        "excluded_direct_attributes": ["y"], "fit_only_prior_id": "eq", "central_prior_id": "c",
        "priors": [{"id": "eq", "label": "", "rationale": "", "base_scores": {"a": 0.5, "b": 0.5}},
                   {"id": "c", "label": "", "rationale": "", "base_scores": {"a": 0.7, "b": 0.3}}]}})
    assert hyb.central_scores() == {"a": 0.7, "b": 0.3} and hyb.excluded_direct_attributes == ("y",)
    emp = Ensemble.from_dict({**base, "empirical_prior": {"evidence": {"a": [{"attribute": "x", "conditions": ["1"]}],
                                                                       "b": [{"attribute": "x", "conditions": ["2"]}]}}})
    assert emp.evidence is not None and emp.evidence.selectors["b"][0].conditions == ("2",)
    assert Ensemble.from_dict({**base, "empirical_prior": {}}).evidence is None
