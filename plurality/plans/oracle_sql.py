"""DuckDB SQL for the correctness oracle.

Independent formulations of the registered queries for an embedded SQL
engine over the same Parquet tables. Built from the same rule parameters;
floats are passed as strings cast to DOUBLE so both engines see the same
bits.
"""

from __future__ import annotations

import math
from itertools import combinations
from typing import Sequence

from plurality.plans import standard as S
from plurality.sources.profiles import packed_dictionary, wide_selection
from plurality.spec import DRAW_SUFFIX, NOISE_SCALE, PRIOR_FLOOR, Catalog, Rule

UINT64 = "CAST('18446744073709551616' AS DOUBLE)"


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


ORDER_PROFILE = """order_profile AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS unit_id, r.r_name AS region, cu.c_mktsegment AS segment,
         o.o_orderpriority AS priority, o.o_orderstatus AS status,
         CASE WHEN l.n_lines IS NULL THEN NULL WHEN l.n_lines <= 2 THEN 'small'
              WHEN l.n_lines <= 5 THEN 'medium' ELSE 'large' END AS basket,
         CASE WHEN l.n_ret IS NULL THEN NULL WHEN l.n_ret > 0 THEN 'Y' ELSE 'N' END AS returned
  FROM orders o
  JOIN customer cu ON o.o_custkey = cu.c_custkey
  JOIN nation n ON cu.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines,
                    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
             FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
)"""

DOCUMENT_PROFILE = """document_profile AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS unit_id, d.lang AS lang, d.source AS source,
         CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 2000 THEN 'medium' ELSE 'long' END AS length_band,
         CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS quality,
         CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END AS toxicity
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

NULL_KEY_PROFILE = """keyed_documents AS (
  SELECT CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('d', CAST(d.doc_id AS VARCHAR)) END AS unit_id, d.lang AS lang,
         CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 2000 THEN 'medium' ELSE 'long' END AS length_band,
         CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

PACKED_PROFILE = """packed_profile AS (
  SELECT doc_id,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('d', CAST(doc_id AS VARCHAR)) END AS source_record_id,
    source, doc_id AS source_row_index,
    CASE WHEN doc_id % 11 = 0 THEN unhex(substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))
         ELSE unhex(md5(CAST(doc_id AS VARCHAR))) END AS attributes,
    CASE WHEN doc_id % 5 = 0 THEN NULL
         ELSE unhex(substr(md5(concat('n', CAST(doc_id AS VARCHAR))), 1, 8)) END AS null_bitmap,
    CASE WHEN doc_id % 3 = 0 THEN [{'field_index': 3, 'value': concat('ov', lang)}, {'field_index': 3, 'value': 'second'}]
         WHEN doc_id % 3 = 1 THEN [{'field_index': 0, 'value': CAST(NULL AS VARCHAR)}, {'field_index': 9, 'value': 'x'}]
    END AS attribute_overrides
  FROM documents
)"""


def rows_of(name: str, columns: str, rows: Sequence[Sequence]) -> str:
    """CTE of literal rows; an empty one keeps its columns."""
    names = [c.split()[0] for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows) or "(" + ", ".join("NULL" for _ in names) + ")"
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in (c.split() for c in columns.split(", ")))
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(names)}){'' if rows else ' WHERE false'})"


def hashed(seed: str, suffix: str, key: str = "unit_id") -> str:
    """Uniform number of a unit and a suffix (an SQL expression)."""
    return f"CAST(md5_number_lower({q(seed + ':')} || {key} || ':' || {suffix}) AS DOUBLE) / {UINT64}"


def model_rows(scenarios) -> tuple[list, list, list]:
    """Literal rows of scenarios [(index, rule)]: choices with their log prior, effects per condition, attributes."""
    priors, effects = [], []
    for k, rule in scenarios:
        for i, c in enumerate(rule.choice_ids):
            priors.append((k, i, c, math.log(max(float(rule.base_scores[c]), PRIOR_FLOOR))))
            for f in rule.factors:
                effects += [(k, f.attribute, v, i, float(f.effects.get(c, 0.0))) for v in dict.fromkeys(f.conditions)]
    return priors, effects, sorted({f.attribute for _, r in scenarios for f in r.factors})


def long_scores(scenarios, seed: str, source: str = "order_profile", mode: str = "expected") -> str:
    """CTEs ``base`` (rows with a key, numbered) and ``dist(rid, k, choice_index,
    score, p)``: one row per unit, scenario and choice; p is the softmax share,
    or in sampled mode 1 for the first choice whose running share passes the draw."""
    priors, effects, attrs = model_rows(scenarios)
    values = " UNION ALL ".join(f"SELECT rid, {q(a)} AS attribute, {a} AS val FROM base" for a in attrs) or "SELECT NULL AS rid, NULL AS attribute, NULL AS val"
    return f"""base AS (SELECT row_number() OVER () AS rid, * FROM {source} WHERE unit_id IS NOT NULL),
{rows_of("model", "k INTEGER, choice_index INTEGER, choice VARCHAR, prior DOUBLE", priors)},
{rows_of("effect", "k INTEGER, attribute VARCHAR, val VARCHAR, choice_index INTEGER, gain DOUBLE", effects)},
gained AS (SELECT rid, k, choice_index, sum(gain) AS gain FROM ({values}) JOIN effect USING (attribute, val) GROUP BY ALL),
noise AS (SELECT rid, choice_index, ({hashed(seed, "choice")} - 0.5) * {dbl(NOISE_SCALE)} AS jitter
          FROM base, (SELECT DISTINCT choice_index, choice FROM model)),
logits AS (SELECT noise.rid, model.k, choice_index, prior + coalesce(gain, 0) + jitter AS score
           FROM noise JOIN model USING (choice_index) LEFT JOIN gained USING (rid, k, choice_index)),
odds AS (SELECT *, exp(score - max(score) OVER (PARTITION BY rid, k)) AS odd FROM logits),
share AS (SELECT * EXCLUDE odd, odd / sum(odd) OVER (PARTITION BY rid, k) AS p FROM odds),
""" + ("dist AS (SELECT * FROM share)" if mode == "expected" else f"""running AS (
  SELECT share.*, sum(p) OVER (PARTITION BY rid, k ORDER BY choice_index) AS upto, max(choice_index) OVER (PARTITION BY rid, k) AS last_one,
         {hashed(seed, q(DRAW_SUFFIX))} AS draw FROM share JOIN base USING (rid)),
drawn AS (SELECT *, coalesce(min(choice_index) FILTER (WHERE draw < upto AND choice_index < last_one) OVER (PARTITION BY rid, k), last_one) AS pick FROM running),
dist AS (SELECT rid, k, choice_index, score, CAST(choice_index = pick AS INTEGER)::DOUBLE AS p FROM drawn)""")


def scored_cte(rule: Rule, source: str = "order_profile", mode: str = "expected") -> str:
    """``long_scores`` of one rule and CTE ``probs``: the rows with s0.. and p0.. side by side."""
    wide = ", ".join(f"max({v}) FILTER (WHERE choice_index = {i}) AS {c}{i}" for i in range(len(rule.choices)) for c, v in (("s", "score"), ("p", "p")))
    return f"""{long_scores([(0, rule)], rule.seed, source, mode)},
side AS (SELECT rid, {wide} FROM dist GROUP BY rid),
probs AS (SELECT * EXCLUDE rid FROM base JOIN side USING (rid))"""


def choices_values(rule_choices: Sequence[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {q(c)})" for i, c in enumerate(rule_choices)) + ") AS ch(choice_index, choice)"


def shares_sql(rule: Rule, mode: str = "expected", digits: int = 6) -> str:
    n = len(rule.choices)
    sums = ", ".join(f"sum(p{i}) AS t{i}" for i in range(n))
    pick = "CASE ch.choice_index " + " ".join(f"WHEN {i} THEN t{i}" for i in range(n)) + " END"
    return f"""WITH {ORDER_PROFILE},
{scored_cte(rule, mode=mode)},
tot AS (SELECT count(*) AS n, {sums} FROM probs)
SELECT ch.choice_index, ch.choice, tot.n, round({pick}, {digits}) AS total,
       round({pick} * 100.0 / tot.n, {digits}) AS percent
FROM tot, {choices_values(rule.choice_ids)}"""


def with_orders(rule: Rule, mode: str = "expected") -> str:
    return f"WITH {ORDER_PROFILE},\n{scored_cte(rule, mode=mode)}"


def hash_uniform_sql(rule: Rule) -> str:
    cols = ", ".join(f"{hashed(rule.seed, q(c))} AS u_{c}" for c in rule.choice_ids)
    return f"""WITH {ORDER_PROFILE}
SELECT unit_id, {cols}, {hashed(rule.seed, q(DRAW_SUFFIX))} AS u_sample,
       CAST(md5_number_lower({q(rule.seed + ':')} || unit_id || ':sample') AS VARCHAR) AS h_sample
FROM order_profile"""


def per_row_sql(rule: Rule, prefix: str, digits: int = 9) -> str:
    cols = ", ".join(f"round({prefix}{i}, {digits}) AS {prefix}_{c}" for i, c in enumerate(rule.choice_ids))
    return f"{with_orders(rule)}\nSELECT unit_id, {cols} FROM probs"


def pick(n: int, prefix: str = "t", idx: str = "ch.choice_index") -> str:
    return f"CASE {idx} " + " ".join(f"WHEN {i} THEN {prefix}{i}" for i in range(n)) + " END"


def apportion_sql(rule: Rule, digits: int = 6) -> str:
    n = len(rule.choices)
    sums = ", ".join(f"sum(p{i}) AS t{i}" for i in range(n))
    return f"""{with_orders(rule)},
tot AS (SELECT count(*) AS n, {sums} FROM probs),
lng AS (SELECT ch.choice_index, ch.choice, tot.n, {pick(n)} AS t,
               CAST(round_even({pick(n)}, 0) AS BIGINT) AS r
        FROM tot, {choices_values(rule.choice_ids)}),
rk AS (SELECT *, row_number() OVER (ORDER BY r DESC, choice_index) AS k, sum(r) OVER () AS rsum FROM lng)
SELECT n, choice_index, choice, r + CASE WHEN k = 1 THEN n - rsum ELSE 0 END AS count,
       round(t * 100.0 / n, {digits}) AS percent
FROM rk"""


def breakdown_sql(rule: Rule, catalog: Catalog, digits: int = 6) -> str:
    n = len(rule.choices)
    sums = ", ".join(f"sum(p{i}) AS t{i}" for i in range(n))
    parts = []
    for g in rule.result_groups:
        parts.append(
            f"SELECT {q(g)} AS group_attribute, CASE WHEN {g} IN {in_list(catalog.values(g))} THEN {g} ELSE 'Unknown' END AS group_value, "
            f"count(*) AS n, {sums} FROM probs GROUP BY 2"
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""{with_orders(rule)},
grp AS ({union})
SELECT group_attribute, group_value, n, ch.choice_index, ch.choice, round({pick(n)} * 100.0 / n, {digits}) AS percent
FROM grp, {choices_values(rule.choice_ids)}"""


def segments_body(rule: Rule, catalog: Catalog, min_abs: int = 1000, divisor: int = 100, digits: int = 6) -> str:
    n = len(rule.choices)
    sums = ", ".join(f"sum(p{i}) AS t{i}" for i in range(n))
    attrs = sorted({f.attribute for f in rule.factors if f.attribute in catalog.attributes and f.attribute not in catalog.non_segment})
    parts = []
    for a in attrs:
        parts.append(
            f"SELECT 1 AS arity, {q(a)} AS attr_1, {a} AS value_1, CAST(NULL AS VARCHAR) AS attr_2, CAST(NULL AS VARCHAR) AS value_2, "
            f"count(*) AS n, {sums} FROM probs WHERE {a} IN {in_list(catalog.values(a))} GROUP BY {a}"
        )
    for a, b in combinations(attrs, 2):
        parts.append(
            f"SELECT 2 AS arity, {q(a)} AS attr_1, {a} AS value_1, {q(b)} AS attr_2, {b} AS value_2, "
            f"count(*) AS n, {sums} FROM probs WHERE {a} IN {in_list(catalog.values(a))} AND {b} IN {in_list(catalog.values(b))} "
            f"GROUP BY {a}, {b}"
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""{with_orders(rule)},
tot AS (SELECT count(*) AS nn, {", ".join(f"sum(p{i}) AS a{i}" for i in range(n))} FROM probs),
raw AS ({union}),
seg AS (
  SELECT arity, attr_1, value_1, attr_2, value_2, n, ch.choice_index, ch.choice,
         round({pick(n)} * 100.0 / n, {digits}) AS percent,
         round({pick(n)} * 100.0 / n - {pick(n, "a")} * 100.0 / nn, {digits}) AS lift_pp
  FROM raw, tot, {choices_values(rule.choice_ids)}
  WHERE n >= greatest({min_abs}, nn // {divisor})
)"""


def segments_sql(rule: Rule, catalog: Catalog, arity: int) -> str:
    cols = "arity, attr_1, value_1, attr_2, value_2" if arity == 2 else "arity, attr_1, value_1"
    return f"{segments_body(rule, catalog)}\nSELECT {cols}, n, choice_index, choice, percent, lift_pp FROM seg WHERE arity = {arity}"


def best_segment_sql(rule: Rule, catalog: Catalog) -> str:
    return f"""{segments_body(rule, catalog)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY choice_index ORDER BY lift_pp DESC, n DESC, arity, attr_1, value_1,
                                         attr_2 NULLS FIRST, value_2 NULLS FIRST) AS rk FROM seg)
SELECT ch.choice_index, ch.choice, r.arity, r.attr_1, r.value_1, r.attr_2, r.value_2, r.n, r.percent, r.lift_pp
FROM {choices_values(rule.choice_ids)} LEFT JOIN (SELECT * FROM ranked WHERE rk = 1) r ON r.choice_index = ch.choice_index"""


def missing_sql(rule: Rule) -> str:
    parts = " + ".join(f"sum(CASE WHEN {a} IS NULL THEN 1 ELSE 0 END)" for a in rule.factor_attributes())
    return f"{with_orders(rule)}\nSELECT count(*) AS n_units, CAST({parts} AS BIGINT) AS missing_cells FROM probs"


def coverage_rows_sql(source: str, keys, extra_sql=None, digits: int = 6) -> str:
    parts = []
    for i, (a, conds) in enumerate(keys):
        extra = (", " + extra_sql[i]) if extra_sql else ""
        parts.append(
            f"SELECT {i} AS key_index, {q(a)} AS attribute, {q('|'.join(conds))} AS conditions, count(*) AS n, "
            f"count({a}) AS valid, count(*) - count({a}) AS missing, count(*) FILTER (WHERE {a} IN {in_list(conds)}) AS matched, "
            f"round(count(*) FILTER (WHERE {a} IN {in_list(conds)}) * 100.0 / count(*), {digits}) AS matched_pct_all, "
            f"CASE WHEN count({a}) > 0 THEN round(count(*) FILTER (WHERE {a} IN {in_list(conds)}) * 100.0 / count({a}), {digits}) "
            f"ELSE {dbl(0.0)} END AS matched_pct_valid{extra} FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)


def effect_rows(factors) -> str:
    """CTE ``eff``: one row per factor (owner, position) and choice. factors: [(owner, position, factor, choices)]."""
    return rows_of("eff", "owner VARCHAR, factor_position INTEGER, attribute VARCHAR, conditions VARCHAR, condition_set VARCHAR, choice VARCHAR, effect DOUBLE",
                   [(o, p, f.attribute, "|".join(f.conditions), "|".join(sorted(set(f.conditions))), c, float(f.effects.get(c, 0.0)))
                    for o, p, f, choices in factors for c in choices])


def observed(factors) -> str:
    """CTE ``cov``: coverage per factor, numbered as given."""
    return f"cov AS ({coverage_rows_sql('order_profile', [(f.attribute, f.conditions) for _, _, f, _ in factors])})"


def top_factors_body(rule: Rule) -> str:
    factors = [("", p, f, rule.choice_ids) for p, f in enumerate(rule.factors)]
    return f"""WITH {ORDER_PROFILE},
{effect_rows(factors)},
{observed(factors)},
strength AS (SELECT factor_position, attribute, conditions, max(abs(effect)) AS max_abs_effect FROM eff GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY max_abs_effect DESC, factor_position) AS INTEGER) AS rank FROM strength)"""


def top_factors_sql(rule: Rule) -> str:
    return f"""{top_factors_body(rule)}
SELECT rank, factor_position, r.attribute, r.conditions, max_abs_effect, n, valid, matched, matched_pct_all
FROM ranked r JOIN cov ON cov.key_index = r.factor_position WHERE rank <= 3"""


def evidence_counts_sql(evidence, choices) -> str:
    def match(sel):
        return "(" + " OR ".join(f"{x.attribute} IN {in_list(x.conditions)}" for x in sel) + ")"

    def obs(sel):
        return "(" + " OR ".join(f"{x.attribute} IS NOT NULL" for x in sel) + ")"

    cols = ["count(*) AS n"]
    for i, c in enumerate(choices):
        cols.append(f"count(*) FILTER (WHERE {match(evidence.selectors[c])}) AS matched{i}")
        cols.append(f"count(*) FILTER (WHERE {obs(evidence.selectors[c])}) AS valid{i}")
    anym = " OR ".join(match(evidence.selectors[c]) for c in choices)
    cols.append(f"count(*) FILTER (WHERE {anym}) AS any_match")
    return f"WITH {DOCUMENT_PROFILE},\nev AS (SELECT {', '.join(cols)} FROM document_profile)"


def prior_evidence_sql(evidence, choices, digits: int = 6) -> str:
    n = len(choices)
    msum = " + ".join(f"matched{i}" for i in range(n))
    return f"""{evidence_counts_sql(evidence, choices)}
SELECT n, any_match, round(any_match * 100.0 / n, {digits}) AS any_match_pct, ch.choice_index, ch.choice,
       {pick(n, "matched")} AS matched, {pick(n, "valid")} AS valid, n - {pick(n, "valid")} AS missing,
       round({pick(n, "matched")} * 100.0 / n, {digits}) AS matched_pct_all,
       round({pick(n, "matched")} * 100.0 / ({msum}), {digits}) AS share_of_matches
FROM ev, {choices_values(choices)}"""


def prior_empirical_sql(evidence, choices, authored) -> str:
    n = len(choices)
    msum = " + ".join(f"matched{i}" for i in range(n))
    auth = "CASE ch.choice_index " + " ".join(f"WHEN {i} THEN {dbl(authored[c])}" for i, c in enumerate(choices)) + " END"
    return f"""{evidence_counts_sql(evidence, choices)}
SELECT ch.choice_index, ch.choice,
       CASE WHEN ({msum}) = 0 THEN {auth} ELSE {pick(n, "matched")} / CAST(({msum}) AS DOUBLE) END AS prior,
       CASE WHEN ({msum}) = 0 THEN 'authored' ELSE 'empirical' END AS source
FROM ev, {choices_values(choices)}"""


def factor_coverage_sql(factors) -> str:
    return f"WITH {DOCUMENT_PROFILE}\n{coverage_rows_sql('document_profile', list(dict.fromkeys((f.attribute, tuple(f.conditions)) for f in factors)))}"


def ensemble_sums_cte(ens, priors, mode: str = "expected") -> str:
    """CTE ``sums(prior_id, prior_index, perspective_id, perspective_index, choice_index, choice, n, total)``."""
    grid = [(h, pid, p, persp, ens.rule_for(persp, prior)) for h, (pid, prior) in enumerate(priors) for p, persp in enumerate(ens.perspectives)]
    names = [(k, pid, h, persp.id, p) for k, (h, pid, p, persp, _) in enumerate(grid)]
    return f"""WITH {ORDER_PROFILE},
{long_scores([(k, g[-1]) for k, g in enumerate(grid)], ens.seed, mode=mode)},
{rows_of("scenario", "k INTEGER, prior_id VARCHAR, prior_index INTEGER, perspective_id VARCHAR, perspective_index INTEGER", names)},
sums AS (SELECT prior_id, prior_index, perspective_id, perspective_index, choice_index, choice, (SELECT count(*) FROM base) AS n, total
         FROM (SELECT k, choice_index, sum(p) AS total FROM dist GROUP BY ALL) JOIN scenario USING (k) JOIN model USING (k, choice_index))"""


def central_priors(ens):
    return [(ens.central_prior_id, ens.central_scores())]


def all_priors(ens):
    return [(p.id, p.base_scores) for p in ens.priors] if ens.priors else central_priors(ens)


def persp_shares_cte(ens, digits: int = 6, mode: str = "expected") -> str:
    return f"""{ensemble_sums_cte(ens, central_priors(ens), mode)},
ps AS (SELECT perspective_id, perspective_index, choice_index, choice, n, round(total, {digits}) AS total,
              round(total * 100.0 / n, {digits}) AS percent FROM sums)"""


def winners_cte() -> str:
    return """wn AS (SELECT perspective_id, choice AS winner, percent FROM (
  SELECT *, row_number() OVER (PARTITION BY perspective_id ORDER BY percent DESC, choice_index) AS rk FROM ps) WHERE rk = 1)"""


def ensemble_perspectives_sql(ens, mode: str = "expected") -> str:
    return f"{persp_shares_cte(ens, mode=mode)}\nSELECT * FROM ps"


def per_perspective_sql(ens, body) -> str:
    """Union of a single-rule query over the perspectives' rules."""
    return "\nUNION ALL\n".join(f"SELECT {q(p.id)} AS perspective_id, * FROM ({body(ens.rule_for(p))})" for p in ens.perspectives)


def ensemble_winners_sql(ens) -> str:
    return f"{persp_shares_cte(ens)},\n{winners_cte()}\nSELECT * FROM wn"


def ensemble_consensus_sql(ens, digits: int = 6) -> str:
    return f"""{persp_shares_cte(ens)},
pc AS (SELECT choice_index, choice, any_value(n) AS n, avg(percent) AS mean, min(percent) AS min_pct, max(percent) AS max_pct
       FROM ps GROUP BY choice_index, choice),
rc AS (SELECT *, CAST(round_even(mean * n / 100.0, 0) AS BIGINT) AS r FROM pc),
rk AS (SELECT *, row_number() OVER (ORDER BY r DESC, choice_index) AS k, sum(r) OVER () AS rsum FROM rc)
SELECT n, choice_index, choice, round(mean, {digits}) AS percent, min_pct, max_pct, round(max_pct - min_pct, {digits}) AS width_pp,
       r + CASE WHEN k = 1 THEN n - rsum ELSE 0 END AS count
FROM rk"""


def ensemble_stability_sql(ens) -> str:
    return f"""{persp_shares_cte(ens)},
{winners_cte()},
wc AS (SELECT winner AS choice, count(*) AS wins FROM wn GROUP BY winner)
SELECT choice, wins, CASE WHEN max(wins) OVER () = {len(ens.perspectives)} THEN 'stable' ELSE 'contested' END AS status,
       CASE WHEN max(wins) OVER () = {len(ens.perspectives)} THEN choice END AS stable_winner
FROM wc"""


def scenarios_cte(ens, digits: int = 6) -> str:
    return f"""{ensemble_sums_cte(ens, all_priors(ens))},
scen AS (SELECT prior_id, prior_index, choice_index, choice, round(avg(round(total * 100.0 / n, {digits})), {digits}) AS percent
         FROM sums GROUP BY prior_id, prior_index, choice_index, choice)"""


def prior_sensitivity_sql(ens) -> str:
    return f"{scenarios_cte(ens)}\nSELECT * FROM scen"


def prior_verdict_sql(ens, digits: int = 6) -> str:
    return f"""{scenarios_cte(ens)},
rk AS (SELECT *, row_number() OVER (PARTITION BY prior_id ORDER BY percent DESC, choice_index) AS r FROM scen),
per AS (SELECT prior_id, prior_index, max(CASE WHEN r = 1 THEN choice END) AS top_choice,
               round(max(CASE WHEN r = 1 THEN percent END) - max(CASE WHEN r = 2 THEN percent END), {digits}) AS margin_pp
        FROM rk GROUP BY prior_id, prior_index),
pw AS (SELECT *, CASE WHEN margin_pp >= 1.0 THEN top_choice END AS winner FROM per),
st AS (SELECT count(winner) = count(*) AND count(DISTINCT winner) = 1 AS stable, max(winner) AS w FROM pw)
SELECT prior_id, prior_index, top_choice, margin_pp, winner,
       CASE WHEN winner IS NOT NULL THEN 'winner' ELSE 'near_tie' END AS verdict,
       CASE WHEN st.stable THEN 'stable' ELSE 'assumption_sensitive' END AS status,
       CASE WHEN st.stable THEN st.w END AS stable_winner
FROM pw, st"""


def prior_range_sql(ens) -> str:
    return f"{scenarios_cte(ens)}\nSELECT choice_index, choice, min(percent) AS min_pct, max(percent) AS max_pct FROM scen GROUP BY 1, 2"


def directions_cte(ens) -> str:
    factors = [(p.id, pos, f, ens.choice_ids) for p in ens.perspectives for pos, f in enumerate(p.factors)]
    numbers = rows_of("number", "owner VARCHAR, factor_position INTEGER, key_index INTEGER", [(o, p, k) for k, (o, p, _, _) in enumerate(factors)])
    return f"""WITH {ORDER_PROFILE},
{effect_rows(factors)},
{observed(factors)},
{numbers},
leader AS (SELECT *, rank() OVER (PARTITION BY owner, factor_position ORDER BY effect DESC) AS r FROM eff),
ways AS (SELECT owner, factor_position, any_value(attribute) AS attribute, any_value(conditions) AS conditions, any_value(condition_set) AS condition_set,
                CASE WHEN count(*) FILTER (WHERE r = 1) = 1 THEN max(choice) FILTER (WHERE r = 1) END AS direction FROM leader GROUP BY owner, factor_position)"""


def factor_direction_sql(ens) -> str:
    return f"""{directions_cte(ens)}
SELECT owner AS perspective_id, factor_position, w.attribute, w.conditions, direction, valid, matched, matched_pct_valid
FROM ways w JOIN number USING (owner, factor_position) JOIN cov USING (key_index)"""


def robust_signals_sql(ens) -> str:
    place = rows_of("place", "owner VARCHAR, pos INTEGER", [(p.id, i) for i, p in enumerate(ens.perspectives)])
    return f"""{directions_cte(ens)},
{place},
backed AS (SELECT attribute, condition_set, direction, owner, any_value(pos) AS pos, min(key_index) AS key_index
           FROM ways JOIN place USING (owner) JOIN number USING (owner, factor_position) WHERE direction IS NOT NULL GROUP BY ALL)
SELECT b.attribute, condition_set AS conditions, direction AS supports, CAST(count(*) AS INTEGER) AS perspective_count,
       string_agg(owner, ',' ORDER BY pos) AS perspectives, any_value(valid) AS valid, any_value(matched) AS matched
FROM backed b JOIN cov USING (key_index) GROUP BY b.attribute, condition_set, direction HAVING count(*) >= 2"""


def row_accounting_sql(rule: Rule, digits: int = 6) -> str:
    """Shares over documents whose key is NULL for some, with the row counts."""
    sums = ", ".join(f"sum(p{i}) AS t{i}" for i in range(len(rule.choices)))
    return f"""WITH {NULL_KEY_PROFILE},
{scored_cte(rule, "keyed_documents")},
tot AS (SELECT {sums} FROM probs),
num AS (SELECT count(*) AS n_rows, count(unit_id) AS n_scored, count(*) - count(unit_id) AS n_null_key FROM keyed_documents)
SELECT n_rows, n_scored, n_null_key, ch.choice_index, ch.choice, round({pick(len(rule.choices))}, {digits}) AS total,
       round({pick(len(rule.choices))} * 100.0 / n_scored, {digits}) AS percent
FROM tot, num, {choices_values(rule.choice_ids)}"""


def score_rules_sql(rules, digits: int = 9) -> str:
    """Logits of several stored rules; each has its own seed."""
    return "\nUNION ALL\n".join(
        f"""SELECT * FROM (WITH {ORDER_PROFILE},
{long_scores([(0, r)], r.seed)}
SELECT {q(rid)} AS rule_id, unit_id, choice_index, choice, round(score, {digits}) AS score FROM dist JOIN base USING (rid) JOIN model USING (k, choice_index))"""
        for rid, r in rules.items())


def result_rows_sql(rule: Rule, catalog: Catalog) -> str:
    """The report's blocks as one typed table; columns a block lacks are NULL."""
    blocks = {
        "rows": f"WITH {ORDER_PROFILE} SELECT count(*) AS n_rows, count(unit_id) AS n_scored, count(*) - count(unit_id) AS n_null_key FROM order_profile",
        "choices": apportion_sql(rule),
        "groups": breakdown_sql(rule, catalog),
        "preference_groups": best_segment_sql(rule, catalog),
        "missing": missing_sql(rule),
        "top_factors": f"""{top_factors_body(rule)} SELECT rank, factor_position, r.attribute, r.conditions, max_abs_effect, valid, matched
                           FROM ranked r JOIN cov ON cov.key_index = r.factor_position WHERE rank <= 3""",
    }
    return "\nUNION ALL BY NAME\n".join(f"SELECT {q(k)} AS block, * FROM ({v})" for k, v in blocks.items())


def ensemble_rows_sql(ens, catalog: Catalog) -> str:
    blocks = {
        "rows": f"WITH {ORDER_PROFILE} SELECT count(*) AS n_rows, count(unit_id) AS n_scored, count(*) - count(unit_id) AS n_null_key FROM order_profile",
        "prior": f"SELECT choice, {dbl(0.0)} + CASE choice " + " ".join(f"WHEN {q(c)} THEN {dbl(v)}" for c, v in ens.central_scores().items())
                 + f" END AS prior, 'hybrid_sensitivity' AS mode FROM {choices_values(ens.choice_ids)}",
        "perspectives": ensemble_perspectives_sql(ens),
        "winners": ensemble_winners_sql(ens),
        "choices": ensemble_consensus_sql(ens),
        "winner_assessment": ensemble_stability_sql(ens),
        "factors": f"""{directions_cte(ens)} SELECT key_index, owner AS perspective_id, factor_position, w.attribute, w.conditions, direction, n, valid, missing, matched,
                       matched_pct_all, matched_pct_valid FROM ways w JOIN number USING (owner, factor_position) JOIN cov USING (key_index)""",
        "robust_signals": f"SELECT attribute, conditions, supports, perspective_count, perspectives FROM ({robust_signals_sql(ens)})",
        "preference_groups": per_perspective_sql(ens, lambda r: best_segment_sql(r, catalog)),
        "missing": per_perspective_sql(ens, missing_sql),
        "prior_sensitivity": prior_sensitivity_sql(ens),
        "prior_verdicts": prior_verdict_sql(ens),
        "choice_ranges": prior_range_sql(ens),
    }
    return "\nUNION ALL BY NAME\n".join(f"SELECT {q(k)} AS block, * FROM ({v})" for k, v in blocks.items())


PACKED_KEY = "coalesce(source_record_id, source || ':' || CAST(source_row_index AS VARCHAR))"


def decode_field_sql(i: int, values) -> str:
    """First override entry (comprehension), else NULL when the bitmap bit is
    set, else the value list at the field's nibble; bytes read as integers."""
    first_override = f"[x.value FOR x IN coalesce(attribute_overrides, []) IF x.field_index = {i}][1]"
    byte_at = lambda blob, k: f"CAST('0x' || substr(hex({blob}), {2 * k + 1}, 2) AS INTEGER)"
    nibble = f"({byte_at('attributes', i // 2)} >> {4 * (i % 2)}) % 16"
    bit_set = f"coalesce(octet_length(null_bitmap) > {i // 8} AND ({byte_at('null_bitmap', i // 8)} >> {i % 8}) % 2 = 1, false)"
    lst = "[" + ", ".join(q(v) for v in values) + "]"
    lookup = f"if(octet_length(attributes) > {i // 2}, {lst}[{nibble} + 1], NULL)"
    return f"coalesce({first_override}, if({bit_set}, NULL, {lookup}))"


def decode_wide_sql(fields, select=None, source: str = PACKED_PROFILE) -> str:
    cols = ", ".join(f"{decode_field_sql(i, vals)} AS {name}" for i, (name, vals) in enumerate(fields) if select is None or name in select)
    return f"WITH {source}\nSELECT {PACKED_KEY} AS unit_id, {cols} FROM packed_profile"


def decode_long_sql(fields) -> str:
    return f"""WITH wide AS ({decode_wide_sql(fields)}),
lng AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR field IN ({", ".join(name for name, _ in fields)})))
SELECT unit_id, CAST(substr(field, 2) AS INTEGER) AS field_index, field, value FROM lng"""


def overrides_sql(fields) -> str:
    return f"""WITH {PACKED_PROFILE},
ov AS (SELECT {PACKED_KEY} AS unit_id, unnest(attribute_overrides) AS e, generate_subscripts(attribute_overrides, 1) AS pos
       FROM packed_profile),
fst AS (SELECT unit_id, e.field_index AS field_index, e.value AS value,
               row_number() OVER (PARTITION BY unit_id, e.field_index ORDER BY pos) AS rk FROM ov)
SELECT unit_id, field_index, 'f' || CAST(field_index AS VARCHAR) AS field, value
FROM fst WHERE rk = 1 AND value IS NOT NULL AND field_index >= 0 AND field_index < {len(fields)}"""


def length_audit_sql(n_fields: int) -> str:
    wa, wb = -(-n_fields // 2), -(-n_fields // 8)

    def st(c, w):
        return (f"CASE WHEN {c} IS NULL THEN 'absent' WHEN octet_length({c}) < {w} THEN 'short' "
                f"WHEN octet_length({c}) > {w} THEN 'long' ELSE 'ok' END")

    return f"""WITH {PACKED_PROFILE}
SELECT {st('attributes', wa)} AS attributes_status, {st('null_bitmap', wb)} AS bitmap_status, count(*) AS n,
       min(octet_length(attributes)) AS min_bytes, max(octet_length(attributes)) AS max_bytes
FROM packed_profile GROUP BY 1, 2"""


PACKED_FIELDS = packed_dictionary(32)
#: the packed profile with NULL entries and entries without a field index before the others
DIRTY_PROFILE = PACKED_PROFILE.replace("END AS attribute_overrides", """END AS clean_overrides""").replace("packed_profile AS", "clean_profile AS") + """,
packed_profile AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN
    list_concat([NULL, {'field_index': CAST(NULL AS INTEGER), 'value': 'lost'}], coalesce(clean_overrides, [])) ELSE clean_overrides END AS attribute_overrides
  FROM clean_profile)"""


def manifest_sql() -> str:
    """Pages against a manifest made from them with planted faults."""
    return """WITH made AS (
  SELECT page_id, CASE WHEN page_id % 10 = 1 THEN octet_length(encode(html)) + 1 ELSE octet_length(encode(html)) END AS bytes,
         CASE WHEN page_id % 10 = 2 THEN sha256(html || '!') ELSE sha256(html) END AS sha256 FROM pages WHERE page_id % 10 <> 3
  UNION ALL SELECT page_id + 1000000000, 7, sha256('gone') FROM pages WHERE page_id % 50 = 0),
found AS (SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages)
SELECT coalesce(m.page_id, f.page_id) AS name, m.bytes AS expected_bytes, f.bytes AS bytes,
  CASE WHEN f.page_id IS NULL THEN 'missing' WHEN m.page_id IS NULL THEN 'unlisted' WHEN m.bytes <> f.bytes THEN 'size_mismatch'
       WHEN m.sha256 <> f.sha256 THEN 'hash_mismatch' ELSE 'ok' END AS status
FROM made m FULL OUTER JOIN found f ON m.page_id = f.page_id"""


def scan_union_sql() -> str:
    return """SELECT 'benchmark.parquet' AS file_name, count(*) AS rows, count(text) AS texts,
       CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS with_doc_id, count(item_id) AS with_item_id FROM benchmark
UNION ALL
SELECT 'documents.parquet', count(*), count(text), CAST(sum(length(text)) AS BIGINT), count(doc_id), CAST(0 AS BIGINT) FROM documents"""


DUCK_TO_SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                      "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "FLOAT": "float", "BOOLEAN": "boolean", "DATE": "date"}


def describe_sql(table: str) -> str:
    mapping = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in DUCK_TO_SPARK_TYPE.items())
    return f"""SELECT (SELECT count(*) FROM {table}) AS rows, CAST(ordinal_position - 1 AS INTEGER) AS column_index,
       column_name AS name, CASE data_type {mapping} ELSE lower(data_type) END AS type
FROM information_schema.columns WHERE table_name = {q(table)}"""


def order_profile_sql() -> str:
    return f"WITH {ORDER_PROFILE}\nSELECT * FROM order_profile"


def readiness_sql(catalog: Catalog, table_cols) -> str:
    present = [a for a in catalog.attributes if a in table_cols]
    rows = []
    for a in sorted(set(catalog.attributes) | set(table_cols)):
        in_cat, in_tab = a in catalog.attributes, a in table_cols
        status = "ok" if in_cat and in_tab else ("missing_in_table" if in_cat else "not_in_catalog")
        nn = f"count({a})" if a in present else "CAST(NULL AS BIGINT)"
        rows.append(f"SELECT count(*) AS n, {q(a)} AS attribute, {str(in_cat).upper()} AS in_catalog, "
                    f"{str(in_tab).upper()} AS in_table, {nn} AS non_null, {q(status)} AS status FROM order_profile")
    return f"WITH {ORDER_PROFILE}\n" + "\nUNION ALL\n".join(rows)


def dictionary_sql(catalog: Catalog) -> str:
    vals = ", ".join(
        f"({q(catalog.domains.get(a, ''))}, {q(a)}, {code}, {q(v)}, {str(a in catalog.breakdowns).upper()}, "
        f"{str(catalog.is_segment(a)).upper()})"
        for a, vs in catalog.attributes.items() for code, v in enumerate(vs)
    )
    unp = "\nUNION ALL\n".join(f"SELECT {q(a)} AS attribute, {a} AS value FROM order_profile WHERE {a} IS NOT NULL"
                                 for a in catalog.attributes)
    return f"""WITH {ORDER_PROFILE},
decl AS (SELECT * FROM (VALUES {vals}) AS t(domain, attribute, code, value, is_breakdown, is_segment)),
seen AS (SELECT attribute, value, count(*) AS observed FROM ({unp}) GROUP BY 1, 2)
SELECT coalesce(d.attribute, s.attribute) AS attribute, coalesce(d.value, s.value) AS value, d.code, d.domain,
       d.is_breakdown, d.is_segment, d.code IS NOT NULL AS in_catalog, coalesce(s.observed, 0) AS observed
FROM decl d FULL OUTER JOIN seen s ON d.attribute = s.attribute AND d.value = s.value"""


def seed_column_sql() -> str:
    return r"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS fingerprint FROM documents"""


def synthetic_sql(attributes) -> str:
    key = "'demo-' || CAST(o_orderkey AS VARCHAR)"
    cols = ", ".join(
        f"[{', '.join(q(v) for v in vals)}][CAST(md5_number_lower({key} || {q(':' + name)}) % {len(vals)} AS BIGINT) + 1] AS {name}"
        for name, vals in attributes.items()
    )
    return f"SELECT {key} AS unit_id, {cols} FROM orders"


def fields_cte(tables) -> str:
    rank = "CASE table_name " + " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(tables)) + " END"
    return f"""fields AS (
  SELECT CAST(row_number() OVER (ORDER BY {rank}, ordinal_position) - 1 AS INTEGER) AS field_index,
         column_name AS id, table_name || '.' || column_name AS label, table_name AS category
  FROM information_schema.columns WHERE table_name IN {in_list(tables)})"""


def classified_cte(tables, clf) -> str:
    arms_d, arms_r = [], []
    arms_d.append(f"WHEN id IN {in_list(sorted(clf.core_ids))} THEN {q(clf.core_domain)}")
    arms_r.append(f"WHEN id IN {in_list(sorted(clf.core_ids))} THEN 'core_id'")
    for dom, ids in clf.extra_ids:
        arms_d.append(f"WHEN id IN {in_list(sorted(ids))} THEN {q(dom)}")
        arms_r.append(f"WHEN id IN {in_list(sorted(ids))} THEN 'extra_id'")
    for dom, cats in clf.category_domains:
        arms_d.append(f"WHEN category IN {in_list(sorted(cats))} THEN {q(dom)}")
        arms_r.append(f"WHEN category IN {in_list(sorted(cats))} THEN 'category'")
    if clf.fallback_pattern:
        cond = f"regexp_matches(id || ' ' || label, {q(clf.fallback_pattern)}, 'i')"
        arms_d.append(f"WHEN {cond} THEN {q(clf.fallback_domain)}")
        arms_r.append(f"WHEN {cond} THEN 'pattern'")
    sens = f"regexp_matches(id, {q(clf.sensitive_pattern)}, 'i')"
    return f"""{fields_cte(tables)},
st AS (SELECT *, CASE WHEN {sens} THEN NULL ELSE CASE {' '.join(arms_d)} END END AS d,
              CASE WHEN {sens} THEN 'sensitive' ELSE coalesce(CASE {' '.join(arms_r)} END, 'unmatched') END AS r
       FROM fields),
rk AS (SELECT *, row_number() OVER (PARTITION BY id, d IS NOT NULL ORDER BY field_index) AS k FROM st),
classified AS (SELECT field_index, id, label, category,
                      CASE WHEN d IS NOT NULL AND k > 1 THEN NULL ELSE d END AS domain,
                      CASE WHEN d IS NOT NULL AND k > 1 THEN 'duplicate' ELSE r END AS reason FROM rk)"""


def classify_fields_sql(tables, clf) -> str:
    return f"WITH {classified_cte(tables, clf)}\nSELECT * FROM classified"


def classify_index_sql(tables, clf) -> str:
    decl = ", ".join(f"({i}, {q(d)})" for i, d in enumerate(clf.domains))
    return f"""WITH {classified_cte(tables, clf)}
SELECT v.domain_order, v.domain, CAST(count(c.id) AS BIGINT) AS attribute_count
FROM (VALUES {decl}) AS v(domain_order, domain) LEFT JOIN classified c ON c.domain = v.domain
GROUP BY 1, 2"""


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return dbl(v)
    return q(v)


def values_table(name: str, schema: str, rows) -> str:
    cols = [c.strip().split(" ") for c in schema.split(",")]
    names = ", ".join(c[0] for c in cols)
    types = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    if not rows:
        sel = ", ".join(f"CAST(NULL AS {types[t]}) AS {n}" for n, t in cols)
        return f"{name} AS (SELECT {sel} WHERE FALSE)"
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {types[t]}) AS {n}" for n, t in cols)
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({names}))"


def closest_ctes(unknown: str, known: str) -> str:
    """CTE ``near (unknown, known, ratio)``: the known name whose matching
    blocks (longest first, then on both sides of it) cover most of both names;
    ``unknown`` and ``known`` are queries of one column each."""
    common = "len([x FOR x IN range(1, least(ahi - i, bhi - j) + 1) IF substr(k, i + 1, x) = substr(u, j + 1, x)])"
    best = f"list_max(flatten([[{{'n': {common}, 'i': -i, 'j': -j}} FOR j IN range(blo, bhi)] FOR i IN range(alo, ahi)]))"
    chars = "list_sum([least(len(k) - len(replace(k, c, '')), len(u) - len(replace(u, c, ''))) FOR c IN list_distinct(string_split(u, ''))])"
    return f"""near_pairs AS (SELECT u, k FROM (SELECT DISTINCT * FROM ({unknown}) AS a(u)), (SELECT DISTINCT * FROM ({known}) AS b(k))
  WHERE u IS NOT NULL AND k IS NOT NULL AND 2.0 * least(len(u), len(k)) >= 0.82 * (len(u) + len(k)) - 1e-9 AND 2.0 * {chars} >= 0.82 * (len(u) + len(k)) - 1e-9),
near_blocks AS (SELECT u, k, 0::BIGINT AS alo, len(k)::BIGINT AS ahi, 0::BIGINT AS blo, len(u)::BIGINT AS bhi, 0::BIGINT AS n FROM near_pairs
  UNION ALL
  SELECT u, k, s.alo, s.ahi, s.blo, s.bhi, s.n FROM (
    SELECT u, k, unnest([{{'alo': alo, 'ahi': -b.i, 'blo': blo, 'bhi': -b.j, 'n': b.n}},
                         {{'alo': -b.i + b.n, 'ahi': ahi, 'blo': -b.j + b.n, 'bhi': bhi, 'n': 0::BIGINT}}]) AS s
    FROM (SELECT u, k, alo, ahi, blo, bhi, {best} AS b FROM near_blocks WHERE ahi > alo AND bhi > blo) WHERE b.n > 0)),
near AS (SELECT u AS unknown, k AS known, r AS ratio FROM (SELECT u, k, 2.0::DOUBLE * sum(n) / (len(u) + len(k)) AS r FROM near_blocks GROUP BY u, k)
  WHERE r >= 0.82 QUALIFY row_number() OVER (PARTITION BY u ORDER BY r DESC, k DESC) = 1)"""


def rule_audit_sql(rules, catalog: Catalog, sensitive: str, profile_cols) -> str:
    from plurality.operators.audit import SCHEMAS, flatten

    rows = flatten(rules)
    return audit_checks_sql([values_table(k, SCHEMAS[k], rows[k]) for k in SCHEMAS], catalog, sensitive, profile_cols)


def audit_checks_sql(tabs: list[str], catalog: Catalog, sensitive: str, profile_cols) -> str:
    from plurality.operators.audit import MAX_FACTORS, MAX_GROUPS
    from plurality.spec import MAX_ABS_EFFECT, PRIOR_SUM_TOLERANCE

    lo, hi = PRIOR_SUM_TOLERANCE
    known_rows = [(i, a) for i, a in enumerate(catalog.attributes)]
    tabs.append(values_table("known", "pos int, attribute string", known_rows))
    tabs.append(values_table("dic", "attribute string, value string",
                             [(a, v) for a, vs in catalog.attributes.items() for v in vs]))
    tabs.append(values_table("bd", "grp string", [(g,) for g in catalog.breakdowns]))
    attrs = sorted(set(catalog.attributes) & set(profile_cols))
    unp = " UNION ALL ".join(f"SELECT {q(a)} AS attribute, {a} AS condition FROM order_profile WHERE {a} IS NOT NULL" for a in attrs)
    checks = f"""
SELECT m.rule_id, 'A1 choice_count' AS "check", CAST(count(c.choice_id) AS VARCHAR) AS detail FROM meta m LEFT JOIN choices c ON c.rule_id = m.rule_id
  GROUP BY m.rule_id HAVING count(c.choice_id) < 2 OR count(c.choice_id) > 4
UNION ALL SELECT rule_id, 'A1 duplicate_choice', choice_id FROM choices GROUP BY rule_id, choice_id HAVING count(*) > 1
UNION ALL SELECT rule_id, 'A1 reserved_choice_id', choice_id FROM choices WHERE choice_id = {q(DRAW_SUFFIX)}
UNION ALL SELECT coalesce(p.rule_id, c.rule_id), 'A2 prior_keys',
       coalesce(p.choice_id, c.choice_id) || CASE WHEN p.choice_id IS NULL THEN ':missing' ELSE ':extra' END
  FROM (SELECT * FROM priors WHERE role = 'authored') p FULL OUTER JOIN choices c ON p.rule_id = c.rule_id AND p.choice_id = c.choice_id
  WHERE p.choice_id IS NULL OR c.choice_id IS NULL
UNION ALL SELECT rule_id, 'A2 prior_sum', {q(f"outside [{lo}, {hi}]")} FROM priors WHERE role = 'authored' GROUP BY rule_id
  HAVING sum(value) < {lo} OR sum(value) > {hi}
UNION ALL SELECT u.rule_id, 'A3 unknown_attribute', u.attribute || ' -> ' || coalesce(n.known, 'none') FROM factors u LEFT JOIN near n ON n.unknown = u.attribute
  WHERE u.attribute NOT IN (SELECT attribute FROM known)
UNION ALL SELECT c.rule_id, 'A4 invalid_condition', c.attribute || '=' || c.condition FROM conditions c
  WHERE c.attribute IN (SELECT attribute FROM known) AND NOT EXISTS (SELECT 1 FROM dic d WHERE d.attribute = c.attribute AND d.value = c.condition)
UNION ALL SELECT rule_id, 'A4 empty_conditions', attribute FROM factors WHERE n_conditions = 0
UNION ALL SELECT c.rule_id, 'A4 unobserved_condition', c.attribute || '=' || c.condition FROM conditions c
  WHERE c.attribute IN {in_list(attrs)} AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.attribute = c.attribute AND s.condition = c.condition)
UNION ALL SELECT e.rule_id, 'A5 unknown_choice', e.attribute || ':' || e.choice_id FROM effects e
  WHERE NOT EXISTS (SELECT 1 FROM choices c WHERE c.rule_id = e.rule_id AND c.choice_id = e.choice_id)
UNION ALL SELECT rule_id, 'A5 effect_too_large', attribute || ':' || choice_id FROM effects WHERE abs(effect) > {dbl(MAX_ABS_EFFECT)}
UNION ALL SELECT rule_id, 'A5 empty_effects', attribute FROM factors WHERE n_effects = 0
UNION ALL SELECT rule_id, 'A6 sensitive_attribute', attribute FROM factors WHERE regexp_matches(attribute, {q(sensitive)}, 'i')
UNION ALL SELECT rule_id, 'A8 unsupported_group', grp FROM groups WHERE grp NOT IN (SELECT grp FROM bd)
UNION ALL SELECT rule_id, 'A8 too_many_groups', CAST(count(*) AS VARCHAR) FROM groups GROUP BY rule_id HAVING count(*) > {MAX_GROUPS}
UNION ALL SELECT rule_id, 'S max_factors', CAST(count(*) AS VARCHAR) FROM factors GROUP BY rule_id, perspective_id HAVING count(*) > {MAX_FACTORS}
UNION ALL SELECT m.rule_id, 'A11 perspective_count', CAST(count(p.perspective_id) AS VARCHAR) FROM meta m
  LEFT JOIN perspectives p ON p.rule_id = m.rule_id WHERE m.kind = 'ensemble' GROUP BY m.rule_id
  HAVING count(p.perspective_id) < 3 OR count(p.perspective_id) > 5
UNION ALL SELECT rule_id, 'A11 duplicate_perspective', perspective_id FROM perspectives GROUP BY rule_id, perspective_id HAVING count(*) > 1
UNION ALL SELECT p.rule_id, 'A11 perspective_factors', p.perspective_id || ':' || CAST(coalesce(f.n, 0) AS VARCHAR) FROM perspectives p
  LEFT JOIN (SELECT rule_id, perspective_id, count(*) AS n FROM factors GROUP BY 1, 2) f ON f.rule_id = p.rule_id AND f.perspective_id = p.perspective_id
  WHERE coalesce(f.n, 0) < 2 OR coalesce(f.n, 0) > 6
UNION ALL SELECT m.rule_id, 'A10 prior_count', CAST(count(DISTINCT h.prior_id) AS VARCHAR) FROM meta m
  LEFT JOIN hp h ON h.rule_id = m.rule_id WHERE m.hybrid GROUP BY m.rule_id
  HAVING count(DISTINCT h.prior_id) < 3 OR count(DISTINCT h.prior_id) > 5
UNION ALL SELECT rule_id, 'A10 duplicate_prior', prior_id FROM hybrid_priors GROUP BY rule_id, prior_id HAVING count(*) > 1
UNION ALL SELECT rule_id, 'A10 prior_values', prior_id FROM hp GROUP BY rule_id, prior_id
  HAVING min(value) <= 0 OR max(value) > 1 OR sum(value) < {lo} OR sum(value) > {hi}
UNION ALL SELECT h.rule_id, 'A10 fit_only_unequal', h.prior_id FROM hp h JOIN meta m ON m.rule_id = h.rule_id AND m.fit_only_prior_id = h.prior_id
  GROUP BY h.rule_id, h.prior_id HAVING max(h.value) - min(h.value) > 0.001
UNION ALL SELECT coalesce(h.rule_id, x.rule_id), 'A10 prior_keys', coalesce(h.prior_id, x.prior_id) || ':' || coalesce(h.choice_id, x.choice_id)
  FROM hp h FULL OUTER JOIN (SELECT DISTINCT i.rule_id, i.prior_id, c.choice_id FROM hp i JOIN choices c ON c.rule_id = i.rule_id) x
    ON h.rule_id = x.rule_id AND h.prior_id = x.prior_id AND h.choice_id = x.choice_id
  WHERE h.choice_id IS NULL OR x.choice_id IS NULL
UNION ALL SELECT m.rule_id, 'A10 central_missing', coalesce(m.central_prior_id, 'NULL') FROM meta m WHERE m.hybrid
  AND NOT EXISTS (SELECT 1 FROM hp h WHERE h.rule_id = m.rule_id AND h.prior_id = m.central_prior_id)
UNION ALL SELECT m.rule_id, 'A10 fit_only_missing', coalesce(m.fit_only_prior_id, 'NULL') FROM meta m WHERE m.hybrid
  AND NOT EXISTS (SELECT 1 FROM hp h WHERE h.rule_id = m.rule_id AND h.prior_id = m.fit_only_prior_id)
UNION ALL SELECT rule_id, 'A10 unknown_excluded', attribute FROM direct WHERE role = 'excluded' AND attribute NOT IN (SELECT attribute FROM known)
UNION ALL SELECT rule_id, 'A10 no_excluded', '' FROM meta m WHERE hybrid AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.rule_id = m.rule_id AND d.role = 'excluded')
UNION ALL SELECT rule_id, 'A7 interactions', CAST(n_interactions AS VARCHAR) FROM meta WHERE n_interactions > 0
UNION ALL SELECT coalesce(e.rule_id, c.rule_id), 'A9 evidence_keys',
       coalesce(e.choice_id, c.choice_id) || CASE WHEN e.choice_id IS NULL THEN ':missing' ELSE ':extra' END
  FROM (SELECT DISTINCT rule_id, choice_id FROM selectors) e
  FULL OUTER JOIN (SELECT c.rule_id, c.choice_id FROM choices c JOIN meta m ON m.rule_id = c.rule_id WHERE m.empirical) c
    ON e.rule_id = c.rule_id AND e.choice_id = c.choice_id
  WHERE e.choice_id IS NULL OR c.choice_id IS NULL
UNION ALL SELECT rule_id, 'A9 selector_count', choice_id || ':' || CAST(count(*) AS VARCHAR) FROM selectors
  GROUP BY rule_id, choice_id HAVING count(*) < 1 OR count(*) > 3
UNION ALL SELECT rule_id, 'A9 unknown_evidence', attribute FROM direct WHERE role = 'evidence' AND attribute NOT IN (SELECT attribute FROM known)
UNION ALL SELECT rule_id, 'A9 empty_selector', attribute FROM selectors WHERE n_conditions = 0
UNION ALL SELECT v.rule_id, 'A9 invalid_selector_value', v.attribute || '=' || v.condition FROM selector_values v
  WHERE v.attribute IN (SELECT attribute FROM known) AND NOT EXISTS (SELECT 1 FROM dic d WHERE d.attribute = v.attribute AND d.value = v.condition)
UNION ALL SELECT rule_id, 'A10 evidence_and_hybrid', '' FROM meta WHERE empirical AND hybrid
UNION ALL SELECT f.rule_id, 'E13 evidence_leak', f.perspective_id || ':' || f.attribute FROM factors f
  WHERE EXISTS (SELECT 1 FROM direct d WHERE d.rule_id = f.rule_id AND d.attribute = f.attribute)"""
    return (f"WITH RECURSIVE {ORDER_PROFILE},\n" + ",\n".join(tabs)
            + ",\n" + closest_ctes("SELECT attribute FROM factors WHERE attribute NOT IN (SELECT attribute FROM known)", "SELECT attribute FROM known")
            + f",\nhp AS (SELECT p.* FROM priors p JOIN meta m ON m.rule_id = p.rule_id WHERE m.hybrid AND p.role = 'hybrid')"
            + f",\nseen AS (SELECT DISTINCT attribute, condition FROM ({unp}))"
            + f"\nSELECT * FROM ({checks})")


def stored_rule_tables() -> list[str]:
    """The flat rule tables of the rules stored per order, as CTEs."""
    def pick(modulus: int, cases: dict, otherwise: str) -> str:
        return f"CASE k % {modulus} " + " ".join(f"WHEN {r} THEN {v}" for r, v in cases.items()) + f" ELSE {otherwise} END"

    def pairs(**values) -> str:
        return "[" + ", ".join(f"{{'c': '{c}', 'v': {dbl(v)}}}" for c, v in values.items()) + "]"

    none = "CAST([] AS STRUCT(c VARCHAR, v DOUBLE)[])"
    prior = lambda name, *v: f"{{'id': '{name}', 's': {pairs(**dict(zip('abc', v)))}}}"
    equal = prior("equal", 0.3334, 0.3333, 0.3333)
    attribute = pick(7, {0: "'priorty'", 1: "'c_phone'"}, "'priority'")
    conditions = pick(7, {2: "['1-URGENT', '9-NEVER']", 3: "CAST([] AS VARCHAR[])"}, "['1-URGENT']")
    effects = pick(7, {4: pairs(a=0.4), 5: pairs(z=0.1), 6: none}, pairs(a=0.1))
    first = f"{{'a': {attribute}, 'c': {conditions}, 'e': {effects}}}"
    second = f"{{'a': 'basket', 'c': ['large'], 'e': {pairs(b=0.1)}}}"
    third = f"{{'a': 'status', 'c': ['F'], 'e': {pairs(a=0.1)}}}"
    view = lambda name, *fs: f"{{'id': '{name}', 'f': [{', '.join(fs)}]}}"
    views = pick(3, {0: f"[{view('p1', first, second)}, {view('p2', first, second)}]",
                     1: f"[{view('p1', first, second)}, {view('p1', first, second)}, {view('p2', second)}, {view('p3', first, second)}]"},
                 f"[{view('p1', first, second)}, {view('p2', first, second)}, {view('p3', first, third)}]")
    priors = pick(4, {0: f"[{prior('equal', 0.4, 0.3, 0.3)}, {prior('central', 0.5, 0.3, 0.2)}]",
                      2: f"[{equal}, {prior('central', 0.5, 0.3, 0.1)}, {prior('strong', 1.2, -0.4, 0.2)}, {prior('strong', 1.2, -0.4, 0.2)}]"},
                  f"[{equal}, {prior('central', 0.5, 0.3, 0.2)}, {prior('strong', 0.7, 0.2, 0.1)}]")
    evidence = ("[{'c': 'a', 'p': 0, 'a': 'priority', 'v': ['1-URGENT', '0-NOW']}, {'c': 'a', 'p': 1, 'a': 'segment', 'v': CAST([] AS VARCHAR[])}, "
                "{'c': 'a', 'p': 2, 'a': 'basket', 'v': ['large']}, {'c': 'a', 'p': 3, 'a': 'returned', 'v': ['Y']}, "
                "{'c': 'b', 'p': 0, 'a': 'colour', 'v': ['red']}, {'c': 'q', 'p': 0, 'a': 'region', 'v': ['ASIA']}]")
    return [
        "ord AS (SELECT o_orderkey AS k, 'r' || o_orderkey AS rule_id, o_orderkey % 5 = 0 AS ens, o_orderkey % 10 = 0 AS hybrid, "
        "o_orderkey % 5 = 0 AND (o_orderkey % 2 = 1 OR o_orderkey % 50 = 0) AS empirical FROM orders)",
        "meta AS (SELECT rule_id, CASE WHEN ens THEN 'ensemble' ELSE 'rule' END AS kind, CASE WHEN hybrid THEN CASE WHEN k % 20 = 0 THEN 'nope' ELSE 'central' END END AS central_prior_id, "
        "CASE WHEN hybrid AND k % 30 <> 0 THEN 'equal' END AS fit_only_prior_id, hybrid, CASE WHEN k % 17 = 0 THEN 2 ELSE 0 END AS n_interactions, empirical FROM ord)",
        f"choices AS (SELECT rule_id, unnest({pick(11, {0: ["a"], 1: ["a", "a", "b"], 2: ["a", "b", "sample"]}, str(["a", "b", "c"]))}) AS choice_id FROM ord)",
        f"ownp AS (SELECT rule_id, unnest({pick(13, {0: pairs(a=0.5, b=0.3), 1: pairs(a=0.5, b=0.3, c=0.2, d=0.0)}, pairs(a=0.5, b=0.3, c=0.2))}) AS x FROM ord)",
        f"hybp AS (SELECT rule_id, unnest({priors}) AS p FROM ord WHERE hybrid)",
        "hybrid_priors AS (SELECT rule_id, p.id AS prior_id FROM hybp)",
        "priors AS (SELECT rule_id, 'authored' AS role, '' AS prior_id, x.c AS choice_id, x.v AS value FROM ownp UNION ALL "
        "SELECT rule_id, 'hybrid', id, x.c, x.v FROM (SELECT rule_id, p.id AS id, unnest(p.s) AS x FROM hybp))",
        f"viewed AS (SELECT rule_id, unnest({views}) AS p FROM ord WHERE ens)",
        "perspectives AS (SELECT rule_id, p.id AS perspective_id FROM viewed)",
        f"facts AS (SELECT rule_id, p.id AS perspective_id, unnest(p.f) AS f FROM viewed UNION ALL SELECT rule_id, '', unnest(CASE WHEN k % 19 = 0 THEN [{first} FOR i IN range(13)] "
        f"ELSE [{first}, {second}] END) FROM ord WHERE NOT ens)",
        "factors AS (SELECT rule_id, perspective_id, f.a AS attribute, len(f.c) AS n_conditions, len(f.e) AS n_effects FROM facts)",
        "conditions AS (SELECT rule_id, f.a AS attribute, unnest(f.c) AS condition FROM facts)",
        "effects AS (SELECT rule_id, attribute, x.c AS choice_id, x.v AS effect FROM (SELECT rule_id, f.a AS attribute, unnest(f.e) AS x FROM facts))",
        f"groups AS (SELECT rule_id, unnest({pick(9, {0: ["region", "segment"], 1: ["region", "status", "region", "status"]}, str(["region"]))}) AS grp FROM ord)",
        f"sels AS (SELECT rule_id, unnest({evidence}) AS s FROM ord WHERE empirical)",
        "selectors AS (SELECT rule_id, s.c AS choice_id, s.p AS pos, s.a AS attribute, len(s.v) AS n_conditions FROM sels)",
        "selector_values AS (SELECT rule_id, s.a AS attribute, unnest(s.v) AS condition FROM sels)",
        f"direct AS (SELECT rule_id, unnest({pick(6, {0: 'CAST([] AS VARCHAR[])', 2: ["status", "planet"]}, str(["status"]))}) AS attribute, 'excluded' AS role FROM ord WHERE hybrid "
        "UNION ALL SELECT rule_id, attribute, 'evidence' FROM selectors)",
    ]


WIDE_PACKED_PROFILE = f"""packed_profile AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('d', doc_id) END AS source_record_id, source, doc_id AS source_row_index,
    unhex(substr({" || ".join(f"md5(doc_id || ':{i}')" for i in range(41))}, 1, CASE WHEN doc_id % 11 = 0 THEN 200 ELSE 1290 END)) AS attributes,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE unhex(substr({" || ".join(f"md5(doc_id || ':n{i}')" for i in range(11))}, 1, 324)) END AS null_bitmap,
    CASE doc_id % 3 WHEN 0 THEN [{{'field_index': 3, 'value': concat('ov', lang)}}, {{'field_index': 3, 'value': 'second'}}, {{'field_index': 1285, 'value': 'end'}}]
      WHEN 1 THEN [{{'field_index': 0, 'value': CAST(NULL AS VARCHAR)}}, {{'field_index': 0, 'value': 'late'}}, {{'field_index': 5, 'value': 'x'}}] END AS attribute_overrides
  FROM documents)"""


def page_files_ctes(pages_per_file: int) -> str:
    """Files as hex text: as listed (x) and as written (y)."""
    return f"""file AS (SELECT page_id // {pages_per_file} AS number, hex(encode(string_agg(coalesce(html, ''), '' ORDER BY page_id))) AS x FROM pages GROUP BY 1),
w AS (SELECT number, number % 7 AS fault, 'pages-' || number || '.bin' AS file_name, x,
  CASE number % 7 WHEN 1 THEN substr(x, 1, 2 * (len(x) // 4)) || '00' || substr(x, 2 * (len(x) // 4) + 3) WHEN 2 THEN substr(x, 1, greatest(len(x) - 10, 0)) ELSE x END AS y FROM file),
s AS (SELECT file_name, x, y, CASE WHEN fault <> 4 THEN (len(x) // 2)::BIGINT END AS expected_bytes, CASE WHEN fault <> 3 THEN (len(y) // 2)::BIGINT END AS bytes,
  CASE WHEN fault = 3 THEN 'missing' WHEN fault = 4 THEN 'unlisted' WHEN len(x) <> len(y) THEN 'size_mismatch' ELSE 'ok' END AS status FROM w)"""


def file_integrity_sql(pages_per_file: int, block: int) -> str:
    return f"""WITH {page_files_ctes(pages_per_file)}
SELECT file_name, expected_bytes, bytes, CASE WHEN status = 'ok' AND x <> y THEN 'hash_mismatch' ELSE status END AS status,
  CASE WHEN status = 'ok' AND x <> y THEN array_to_string([b FOR b IN range((len(x) + {2 * block} - 1) // {2 * block})
    IF substr(x, {2 * block} * b + 1, {2 * block}) <> substr(y, {2 * block} * b + 1, {2 * block})], ',') END AS bad_blocks FROM s"""


def file_completeness_sql(pages_per_file: int) -> str:
    return f"WITH {page_files_ctes(pages_per_file)} SELECT file_name, expected_bytes, bytes, status FROM s"


def catalog_values_sql(domains) -> str:
    return "v AS (" + " UNION ".join(f"SELECT {q(d)} AS domain, {q(c)} AS attribute, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL"
                                     for d, t, cs in domains for c in cs) + ")"


def catalog_load_sql() -> str:
    return f"""WITH {catalog_values_sql(S.CATALOG_DOMAINS)}
SELECT domain, attribute, (row_number() OVER (PARTITION BY attribute ORDER BY value) - 1)::INTEGER AS code, value,
  attribute IN {in_list(S.CATALOG_BREAKDOWNS)} AS is_breakdown, attribute NOT IN {in_list(S.CATALOG_NON_SEGMENT)} AS is_segment FROM v"""


def catalog_duplicates_sql() -> str:
    return f"""WITH {catalog_values_sql([*S.CATALOG_DOMAINS, *S.CATALOG_REPEATED])}
SELECT attribute, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM v GROUP BY attribute HAVING count(DISTINCT domain) > 1"""


def unicode_seed_sql() -> str:
    """The texts hold no compatibility characters; of their letters only sharp s folds otherwise than to lower case."""
    front = "[" + ", ".join(q(p) for p in S.PLANTED_CANONICAL) + f"][doc_id % {len(S.PLANTED_CANONICAL)} + 1]"
    return f"""SELECT doc_id, sha256(trim(regexp_replace({front} || replace(lower(text), '\u00df', 'ss'), '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F]+', ' ', 'g'))) AS seed FROM documents"""


def closest_names_sql() -> str:
    return f"""WITH RECURSIVE hosts AS (SELECT page_id, regexp_extract(url, '://([a-z]+)\\.', 1) AS h, (page_id % 4 + 2)::INTEGER AS p FROM pages),
bad AS (SELECT CASE page_id % 3 WHEN 0 THEN substr(h, 1, p - 1) || substr(h, p + 1) WHEN 1 THEN substr(h, 1, p - 1) || 'q' || substr(h, p + 1) ELSE reverse(h) END AS h FROM hosts),
{closest_ctes("SELECT h FROM bad WHERE h NOT IN (SELECT h FROM hosts)", "SELECT h FROM hosts")}
SELECT unknown, known, round(ratio, 9) AS ratio FROM near"""


ORACLE: dict[str, str] = {
    "share_expected": shares_sql(S.STANDARD_RULE),
    "share_sampled": shares_sql(S.STANDARD_RULE, mode="sampled"),
    "hash_uniform": hash_uniform_sql(S.STANDARD_RULE),
    "score_logits": per_row_sql(S.STANDARD_RULE, "s"),
    "score_logits_join": per_row_sql(S.STANDARD_RULE, "s"),
    "softmax_probs": per_row_sql(S.STANDARD_RULE, "p"),
    "apportion_counts": apportion_sql(S.STANDARD_RULE),
    "breakdown_unknown": breakdown_sql(S.STANDARD_RULE, S.ORDER_CATALOG),
    "segments_1way": segments_sql(S.STANDARD_RULE, S.ORDER_CATALOG, 1),
    "segments_2way": segments_sql(S.STANDARD_RULE, S.ORDER_CATALOG, 2),
    "best_segment": best_segment_sql(S.STANDARD_RULE, S.ORDER_CATALOG),
    "missing_cells": missing_sql(S.STANDARD_RULE),
    "top_factors": top_factors_sql(S.STANDARD_RULE),
    "prior_evidence": prior_evidence_sql(S.DOCUMENT_EVIDENCE, S.STANDARD_RULE.choice_ids),
    "prior_empirical": prior_empirical_sql(S.DOCUMENT_EVIDENCE, S.STANDARD_RULE.choice_ids, S.CENTRAL),
    "factor_coverage": factor_coverage_sql(S.DOCUMENT_FACTORS),
    "ensemble_perspectives": ensemble_perspectives_sql(S.STANDARD_ENSEMBLE),
    "ensemble_sampled": ensemble_perspectives_sql(S.STANDARD_ENSEMBLE, mode="sampled"),
    "ensemble_best_segments": per_perspective_sql(S.STANDARD_ENSEMBLE, lambda r: best_segment_sql(r, S.ORDER_CATALOG)),
    "ensemble_missing_cells": per_perspective_sql(S.STANDARD_ENSEMBLE, missing_sql),
    "row_accounting": row_accounting_sql(S.DOCUMENT_RULE),
    "score_rules_join": score_rules_sql(S.STORED_RULES),
    "result_json": result_rows_sql(S.STANDARD_RULE, S.ORDER_CATALOG),
    "ensemble_json": ensemble_rows_sql(S.STANDARD_ENSEMBLE, S.ORDER_CATALOG),
    "manifest_audit": manifest_sql(),
    "decode_subset": decode_wide_sql(PACKED_FIELDS, [PACKED_FIELDS[i][0] for i in (3, 9, 30)]),
    "decode_dirty_overrides": decode_wide_sql(PACKED_FIELDS, source=DIRTY_PROFILE),
    "ensemble_winners": ensemble_winners_sql(S.STANDARD_ENSEMBLE),
    "ensemble_consensus": ensemble_consensus_sql(S.STANDARD_ENSEMBLE),
    "ensemble_stability": ensemble_stability_sql(S.STANDARD_ENSEMBLE),
    "prior_sensitivity": prior_sensitivity_sql(S.STANDARD_ENSEMBLE),
    "prior_sensitivity_verdict": prior_verdict_sql(S.STANDARD_ENSEMBLE),
    "prior_sensitivity_range": prior_range_sql(S.STANDARD_ENSEMBLE),
    "factor_direction": factor_direction_sql(S.STANDARD_ENSEMBLE),
    "robust_signals": robust_signals_sql(S.STANDARD_ENSEMBLE),
    "decode_packed": decode_wide_sql(PACKED_FIELDS),
    "decode_overrides": overrides_sql(PACKED_FIELDS),
    "decode_long_join": decode_long_sql(PACKED_FIELDS),
    "packed_length_audit": length_audit_sql(len(PACKED_FIELDS)),
    "scan_union_parquet": scan_union_sql(),
    "describe_dataset": describe_sql("lineitem"),
    "sink_roundtrip_zstd": order_profile_sql(),
    "sink_load_summary": f"""WITH {ORDER_PROFILE} SELECT count(*) AS rows, 'basket,priority,region,returned,segment,status,unit_id' AS attributes,
  'parquet' AS format, 'zstd' AS compression FROM order_profile""",
    "schema_readiness": readiness_sql(S.ORDER_CATALOG, ["region", "segment", "priority", "status", "basket", "returned"]),
    "dictionary_long": dictionary_sql(S.ORDER_CATALOG),
    "seed_column": seed_column_sql(),
    "synthetic_profile": synthetic_sql({"color": ["r", "g", "b", "k", "w"], "size": ["S", "M", "L"],
                                        "tier": ["gold", "silver", "bronze", "basic"]}),
    "classify_fields": classify_fields_sql(S.SCHEMA_TABLES, S.TESTDATA_CLASSIFIER),
    "classify_index": classify_index_sql(S.SCHEMA_TABLES, S.TESTDATA_CLASSIFIER),
    "rule_audit": rule_audit_sql(S.AUDIT_RULES, S.ORDER_CATALOG, S.TESTDATA_CLASSIFIER.sensitive_pattern,
                                 ["region", "segment", "priority", "status", "basket", "returned"]),
    "decode_wide_513": decode_wide_sql(packed_dictionary(1290), select=set(wide_selection()), source=WIDE_PACKED_PROFILE),
    "file_integrity": file_integrity_sql(32, 4096),
    "file_completeness": file_completeness_sql(32),
    "catalog_load": catalog_load_sql(),
    "catalog_duplicates": catalog_duplicates_sql(),
    "unicode_seed": unicode_seed_sql(),
    "closest_names": closest_names_sql(),
    "row_group_sizes": "SELECT sum(l_quantity::INTEGER)::BIGINT AS rows, 'ZSTD' AS compression, 0::BIGINT AS oversized, 0::BIGINT AS uneven FROM lineitem",
    "stored_rule_audit": audit_checks_sql(stored_rule_tables(), S.ORDER_CATALOG, S.TESTDATA_CLASSIFIER.sensitive_pattern,
                                          ["region", "segment", "priority", "status", "basket", "returned"]),
}
