"""Declarative rule, ensemble and catalog specifications.

Rules are a few kilobytes of driver configuration. They become literal
Column expressions (scoring) or tiny DataFrames (audits, joins); the data
itself never passes through the driver.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plurality.functions.text import canonical

# Fixed values of the scoring model (must equal the reference's).
PRIOR_FLOOR = 1e-9          # ln(max(prior, 1e-9))
NOISE_SCALE = 0.08          # (u - 0.5) * 0.08, i.e. +-0.04 logit
MAX_ABS_EFFECT = 0.25
PRIOR_SUM_TOLERANCE = (0.999, 1.001)
DRAW_SUFFIX = "sample"      # suffix of the sampled-mode draw


@dataclass(frozen=True)
class Choice:
    id: str
    label: str = ""


@dataclass(frozen=True)
class Factor:
    """``attribute IN conditions`` adds ``effects[choice]`` to that choice's logit."""

    attribute: str
    conditions: tuple[str, ...]
    effects: Mapping[str, float]
    reason: str = ""

    def effect(self, choice: str) -> float:
        return float(self.effects.get(choice, 0.0))


@dataclass(frozen=True)
class Rule:
    question: str
    choices: tuple[Choice, ...]
    base_scores: Mapping[str, float]
    factors: tuple[Factor, ...] = ()
    result_groups: tuple[str, ...] = ()
    seed: str = ""
    interactions: tuple = ()   # reserved: any entry is rejected by the audit

    @property
    def choice_ids(self) -> list[str]:
        return [c.id for c in self.choices]

    def log_prior(self, choice: str) -> float:
        return math.log(max(float(self.base_scores[choice]), PRIOR_FLOOR))

    def factor_attributes(self) -> list[str]:
        return sorted({f.attribute for f in self.factors})

    def needed_attributes(self) -> list[str]:
        return sorted({*self.result_groups, *(f.attribute for f in self.factors)})

    def with_prior(self, base_scores: Mapping[str, float]) -> "Rule":
        return Rule(self.question, self.choices, dict(base_scores), self.factors, self.result_groups, self.seed)

    def with_factors(self, factors: Sequence[Factor]) -> "Rule":
        return Rule(self.question, self.choices, self.base_scores, tuple(factors), self.result_groups, self.seed)

    @staticmethod
    def from_dict(doc: Mapping) -> "Rule":
        """A rule document (question, choices, base_scores, factors,
        interactions, result_groups, seed). The seed is hashed once: from the
        override when given, else from the normalised question."""
        return Rule(
            question=doc["question"],
            choices=_choices(doc),
            base_scores={k: float(v) for k, v in doc.get("base_scores", {}).items()},
            factors=_factors(doc.get("factors", [])),
            result_groups=tuple(doc.get("result_groups", ("region", "age_bracket"))),
            seed=document_seed(doc),
            interactions=tuple(doc.get("interactions", ()) or ()),
        )


def document_seed(doc: Mapping) -> str:
    """Hex seed of a rule or ensemble document. A ``seed`` field is hashed as it
    stands; without one the canonical question is."""
    source = canonical(doc["question"]) if doc.get("seed") is None else doc["seed"]
    return hashlib.sha256(source.encode()).hexdigest()


def _choices(doc: Mapping) -> tuple[Choice, ...]:
    return tuple(Choice(c["id"], c.get("label", "")) for c in doc.get("choices", []))


def _factors(items) -> tuple[Factor, ...]:
    return tuple(
        Factor(f.get("attribute", ""), tuple(f.get("conditions", [])), {k: float(v) for k, v in f.get("effects", {}).items()},
               f.get("reason", ""))
        for f in items
    )


@dataclass(frozen=True)
class Perspective:
    id: str
    label: str
    factors: tuple[Factor, ...]
    rationale: str = ""


@dataclass(frozen=True)
class Prior:
    id: str
    base_scores: Mapping[str, float]
    label: str = ""
    rationale: str = ""


@dataclass(frozen=True)
class Selector:
    attribute: str
    conditions: tuple[str, ...]


@dataclass(frozen=True)
class Evidence:
    """Empirical prior: per choice 1..3 selectors OR-ed together."""

    selectors: Mapping[str, tuple[Selector, ...]]


@dataclass(frozen=True)
class Ensemble:
    question: str
    choices: tuple[Choice, ...]
    base_scores: Mapping[str, float]
    perspectives: tuple[Perspective, ...]
    priors: tuple[Prior, ...] = ()
    central_prior_id: str | None = None
    fit_only_prior_id: str | None = None
    excluded_direct_attributes: tuple[str, ...] = ()
    evidence: Evidence | None = None
    result_groups: tuple[str, ...] = ()
    seed: str = ""
    hybrid: bool = False  # the document has a hybrid block, maybe without priors

    @property
    def choice_ids(self) -> list[str]:
        return [c.id for c in self.choices]

    @property
    def has_hybrid(self) -> bool:
        return self.hybrid or bool(self.priors)

    def central_scores(self) -> Mapping[str, float]:
        if self.central_prior_id is not None:
            return next(p.base_scores for p in self.priors if p.id == self.central_prior_id)
        return self.base_scores

    @staticmethod
    def from_dict(doc: Mapping) -> "Ensemble":
        """An ensemble document: perspectives, and optionally
        ``empirical_prior.evidence`` or ``hybrid_sensitivity`` (priors with
        central and fit-only ids, excluded direct attributes). Empty blocks
        count as absent; the seed is hashed once."""
        empirical = doc.get("empirical_prior") or {}
        hybrid = doc.get("hybrid_sensitivity") or {}
        evidence = None
        if empirical:
            evidence = Evidence({
                choice: tuple(Selector(x.get("attribute", ""), tuple(x.get("conditions", []))) for x in sels)
                for choice, sels in empirical.get("evidence", {}).items()
            })
        return Ensemble(
            question=doc["question"],
            choices=_choices(doc),
            base_scores={k: float(v) for k, v in doc.get("base_scores", {}).items()},
            perspectives=tuple(
                Perspective(p.get("id", ""), p.get("label", ""), _factors(p.get("factors", [])), p.get("rationale", ""))
                for p in doc.get("perspectives", [])
            ),
            priors=tuple(
                Prior(p.get("id", ""), {k: float(v) for k, v in p.get("base_scores", {}).items()}, p.get("label", ""),
                      p.get("rationale", ""))
                for p in hybrid.get("priors", [])
            ),
            central_prior_id=hybrid.get("central_prior_id"),
            fit_only_prior_id=hybrid.get("fit_only_prior_id"),
            excluded_direct_attributes=tuple(hybrid.get("excluded_direct_attributes", [])),
            evidence=evidence,
            result_groups=tuple(doc.get("result_groups", ("region", "age_bracket"))),
            seed=document_seed(doc),
            hybrid=bool(hybrid),
        )

    def rule_for(self, perspective: Perspective, base_scores: Mapping[str, float] | None = None) -> Rule:
        return Rule(
            self.question,
            self.choices,
            dict(base_scores if base_scores is not None else self.central_scores()),
            perspective.factors,
            self.result_groups,
            self.seed,
        )


@dataclass
class Catalog:
    """Legal values per attribute (user input, like a catalog file) and roles.

    Bounded by the number of attributes times their value lists, so it may be
    inlined as literals or broadcast.
    """

    attributes: dict[str, list[str]]
    domains: dict[str, str] = field(default_factory=dict)
    breakdowns: tuple[str, ...] = ()
    non_segment: tuple[str, ...] = ()

    def values(self, attribute: str) -> list[str]:
        return self.attributes[attribute]

    def is_segment(self, attribute: str) -> bool:
        return attribute in self.attributes and attribute not in self.non_segment

    @staticmethod
    def from_frame(long: DataFrame, breakdowns: Sequence[str] = (), non_segment: Sequence[str] = ()) -> "Catalog":
        """From a long dictionary ``(domain, attribute, code, value)`` (for
        example ``sources.files.load_catalog_json``). The catalog is
        configuration bounded by attributes x values (a few thousand rows),
        fetched once to the driver."""
        attrs: dict[str, list[str]] = {}
        domains: dict[str, str] = {}
        for r in long.orderBy("domain", "attribute", "code").collect():
            attrs.setdefault(r["attribute"], []).append(r["value"])
            domains[r["attribute"]] = r["domain"]
        return Catalog(attrs, domains, tuple(breakdowns), tuple(non_segment))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Long dictionary ``(domain, attribute, code, value, is_breakdown, is_segment)``."""
        rows = [
            (self.domains.get(a, ""), a, code, v, a in self.breakdowns, self.is_segment(a))
            for a, vals in self.attributes.items()
            for code, v in enumerate(vals)
        ]
        schema = T.StructType(
            [
                T.StructField("domain", T.StringType()),
                T.StructField("attribute", T.StringType()),
                T.StructField("code", T.IntegerType()),
                T.StructField("value", T.StringType()),
                T.StructField("is_breakdown", T.BooleanType()),
                T.StructField("is_segment", T.BooleanType()),
            ]
        )
        return spark.createDataFrame(rows, schema).coalesce(1)  # configuration: one partition
