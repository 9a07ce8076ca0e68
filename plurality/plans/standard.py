"""Standard parameters of the registered queries: catalogs, one rule, one
ensemble, one evidence spec. These are query parameters (user input); every
query reads the test tables through the profiles in ``sources.profiles``."""

from __future__ import annotations

from plurality.spec import Catalog, Choice, Ensemble, Evidence, Factor, Perspective, Prior, Rule, Selector

# The seed of the standard rule and its model parameters.
STANDARD_SEED = "ab" * 32

CHOICES = (Choice("alpha", "Alpha"), Choice("beta", "Beta"), Choice("gamma", "Gamma"))
CENTRAL = {"alpha": 0.5, "beta": 0.3, "gamma": 0.2}

# Catalog of the order profile. Off-list on purpose: priority 5-LOW, basket small.
ORDER_CATALOG = Catalog(
    attributes={
        "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
        "status": ["F", "O", "P"],
        "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"],
        "basket": ["medium", "large"],
        "returned": ["Y", "N"],
    },
    domains={"region": "geo", "status": "order", "segment": "customer", "priority": "order", "basket": "order", "returned": "order"},
    breakdowns=("region", "status", "basket"),
    non_segment=("region", "status"),
)

F_PRIORITY = Factor("priority", ("1-URGENT", "2-HIGH"), {"alpha": 0.20, "beta": -0.10}, "urgent orders lean alpha")
F_BASKET = Factor("basket", ("large",), {"alpha": -0.15, "beta": 0.25, "gamma": 0.05}, "large baskets lean beta")
F_SEGMENT = Factor("segment", ("BUILDING",), {"beta": 0.10, "gamma": -0.20}, "building segment leans beta")

STANDARD_RULE = Rule(
    question="Which plan would this order choose?",
    choices=CHOICES,
    base_scores=CENTRAL,
    factors=(F_PRIORITY, F_BASKET, F_SEGMENT),
    result_groups=("region", "status", "basket"),
    seed=STANDARD_SEED,
)

PERSPECTIVES = (
    Perspective("price", "Priority and basket", (F_PRIORITY, F_BASKET), "order urgency and size"),
    Perspective(
        "segment",
        "Segment and returns",
        (F_SEGMENT, Factor("returned", ("Y",), {"alpha": 0.05, "gamma": 0.10}, "returners lean gamma")),
        "customer type and history",
    ),
    Perspective(
        "mixed",
        "Priority and returns",
        (
            Factor("priority", ("2-HIGH", "1-URGENT"), {"alpha": 0.15, "beta": -0.05}, "urgent orders lean alpha"),
            Factor("returned", ("N",), {"alpha": -0.10, "beta": 0.10}, "keepers lean beta"),
        ),
        "urgency and history",
    ),
)

PRIORS = (
    Prior("equal", {"alpha": 1 / 3, "beta": 1 / 3, "gamma": 1 / 3}, "Equal", "fit only"),
    Prior("central", CENTRAL, "Central", "authored familiarity"),
    Prior("strong", {"alpha": 0.7, "beta": 0.2, "gamma": 0.1}, "Strong", "incumbent advantage"),
)

STANDARD_ENSEMBLE = Ensemble(
    question=STANDARD_RULE.question,
    choices=CHOICES,
    base_scores=CENTRAL,
    perspectives=PERSPECTIVES,
    priors=PRIORS,
    central_prior_id="central",
    fit_only_prior_id="equal",
    excluded_direct_attributes=("status",),
    result_groups=(),
    seed=STANDARD_SEED,
)

DOCUMENT_EVIDENCE = Evidence(
    {
        "alpha": (Selector("quality", ("good",)), Selector("length_band", ("long",))),
        "beta": (Selector("toxicity", ("toxic",)),),
        "gamma": (Selector("lang", ("fr", "de", "es")), Selector("quality", ("poor",))),
    }
)

DOCUMENT_FACTORS = (
    Factor("quality", ("good",), {"alpha": 0.1}),
    Factor("toxicity", ("clean",), {"beta": 0.1}),
    Factor("length_band", ("long", "medium"), {"gamma": 0.1}),
    Factor("lang", ("en",), {"alpha": -0.1}),
    Factor("quality", ("good",), {"beta": 0.2}),
    Factor("quality", ("poor", "good"), {"gamma": 0.05}),
)

# rule over documents, some of which have no key
DOCUMENT_RULE = Rule(
    question="Which plan would this document choose?",
    choices=CHOICES,
    base_scores=CENTRAL,
    factors=(Factor("quality", ("good",), {"alpha": 0.1}), Factor("length_band", ("long", "medium"), {"gamma": 0.1, "beta": -0.05})),
    seed="cd" * 32,
)

# several stored rules, scored together from their factor table
STORED_RULES = {
    "standard": STANDARD_RULE,
    "returns": Rule("Who returns?", CHOICES[:2], {"alpha": 0.6, "beta": 0.4},
                    (Factor("returned", ("Y",), {"alpha": 0.2, "beta": -0.1}), Factor("segment", ("BUILDING", "MACHINERY"), {"beta": 0.05})), (), "ef" * 32),
    "plain": Rule("No factors?", CHOICES, CENTRAL, (), (), "01" * 32),
}

from plurality.operators.dictionary import Classifier  # noqa: E402

SCHEMA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Classification of the test tables' columns into catalog domains.
TESTDATA_CLASSIFIER = Classifier(
    domains=("core", "orders", "parties", "catalog", "text", "activity", "vectors"),
    sensitive_pattern=r"^c_name$|^s_name$|acctbal|phone|email",
    core_domain="core",
    core_ids=frozenset({"o_orderkey", "c_custkey", "r_name", "n_name", "o_orderpriority"}),
    extra_ids=(("orders", frozenset({"l_orderkey", "l_returnflag"})),),
    category_domains=(
        ("orders", frozenset({"orders", "lineitem"})),
        ("parties", frozenset({"customer", "supplier", "nation", "region"})),
        ("catalog", frozenset({"part"})),
        ("text", frozenset({"documents", "benchmark", "pages", "conversations", "labels"})),
        ("activity", frozenset({"events"})),
    ),
    fallback_pattern=r"vec|embedding",
    fallback_domain="vectors",
)

# Rules for the audit: the standard ones plus one broken rule per group of checks.
AUDIT_RULES = {
    "standard": STANDARD_RULE,
    "ensemble": STANDARD_ENSEMBLE,
    "bad_choices": Rule(
        question="q", choices=(Choice("solo"), Choice("solo")), base_scores={"solo": 0.9, "ghost": 0.05},
        factors=(F_PRIORITY,), result_groups=("region",), seed=STANDARD_SEED,
    ),
    "bad_factors": Rule(
        question="q", choices=CHOICES, base_scores=CENTRAL,
        factors=(
            Factor("priorty", ("1-URGENT",), {"alpha": 0.1}),
            Factor("priority", ("9-NEVER", "5-LOW", "2-HIGH"), {"alpha": 0.4}),
            Factor("basket", (), {}),
            Factor("segment", ("BUILDING",), {"delta": 0.1}),
            Factor("c_phone", ("x",), {"alpha": 0.1}),
        ),
        result_groups=("segment", "region", "status", "basket"), seed=STANDARD_SEED,
    ),
    "bad_ensemble": Ensemble(
        question="q", choices=CHOICES, base_scores=CENTRAL,
        perspectives=(
            Perspective("p", "one", (F_PRIORITY,)),
            Perspective("p", "two", (F_BASKET, Factor("status", ("F",), {"beta": 0.1}))),
        ),
        priors=(
            Prior("flat", {"alpha": 0.3, "beta": 0.3, "gamma": 0.3}),
            Prior("skew", {"alpha": 0.9, "beta": 0.1, "gamma": 0.0}),
        ),
        central_prior_id="nope", fit_only_prior_id="skew",
        excluded_direct_attributes=("status", "planet"),
        seed=STANDARD_SEED,
    ),
    "bad_evidence": Ensemble(
        question="q", choices=CHOICES, base_scores=CENTRAL, perspectives=PERSPECTIVES,
        priors=PRIORS, central_prior_id="central", fit_only_prior_id="equal", excluded_direct_attributes=("status",),
        evidence=Evidence({
            "alpha": (Selector("priority", ("1-URGENT", "0-NOW")), Selector("segment", ()), Selector("basket", ("large",)),
                      Selector("returned", ("Y",))),
            "beta": (Selector("colour", ("red",)),),
            "delta": (Selector("region", ("ASIA",)),),
        }),
        seed=STANDARD_SEED,
    ),
    "bad_interactions": Rule(
        question="q", choices=(Choice("alpha"), Choice("sample")), base_scores={"alpha": 0.5, "sample": 0.5},
        factors=(Factor("priority", ("1-URGENT",), {"alpha": 0.1}),), result_groups=("region",),
        seed=STANDARD_SEED, interactions=({"a": "priority", "b": "basket"},),
    ),
}

# Catalog files written from table columns: (domain, table, columns).
CATALOG_DOMAINS = (
    ("orders", "orders", ("o_orderpriority", "o_orderstatus")),
    ("parties", "customer", ("c_mktsegment",)),
    ("parties", "nation", ("n_name",)),
    ("parties", "region", ("r_name",)),
    ("parts", "part", ("p_brand", "p_name", "p_type")),
    ("texts", "documents", ("lang", "source")),
)
CATALOG_BREAKDOWNS = ("r_name", "lang")
CATALOG_NON_SEGMENT = ("r_name", "lang", "o_orderstatus")
# Attributes declared a second time, in another domain.
CATALOG_REPEATED = (("texts", "orders", ("o_orderstatus",)), ("parties", "documents", ("lang",)))

# Put in front of texts, and what they become: ligatures, full-width forms, sharp s, title case, dotted I, circled digits.
PLANTED_FORMS = ("", "\ufb01nal \uff26\uff55ll\u3000width \u00df ", "\u01c5 \u0130 \ufb00\u00a0", "Stra\u00dfe \u210c \u2460\t")
PLANTED_CANONICAL = ("", "final full width ss ", "d\u017e i\u0307 ff ", "strasse h 1 ")
