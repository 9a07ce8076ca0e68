"""Spark results against a pure-Python brute force on a skewed fixture:
one key holds a third of all rows, one attribute value most of them."""

import hashlib
import math
import random
from itertools import combinations

from plurality.operators import scoring, shares
from plurality.plans import standard as S

RULE = S.STANDARD_RULE
CAT = S.ORDER_CATALOG


def u(seed, key, suffix):
    d = hashlib.md5(f"{seed}:{key}:{suffix}".encode()).digest()
    return int.from_bytes(d[8:16], "little") / 2**64


def brute_probs(row, mode="expected"):
    key = row["unit_id"]
    scores = []
    for c in RULE.choice_ids:
        s = math.log(max(RULE.base_scores[c], 1e-9))
        for f in RULE.factors:
            e = f.effect(c)
            if e and row[f.attribute] in f.conditions:
                s += e
        s += (u(RULE.seed, key, c) - 0.5) * 0.08
        scores.append(s)
    m = max(scores)
    w = [math.exp(x - m) for x in scores]
    p = [x / sum(w) for x in w]
    if mode == "expected":
        return p
    draw, cum = u(RULE.seed, key, "sample"), 0.0
    for i in range(len(p) - 1):
        cum += p[i]
        if draw < cum:
            return [1.0 if j == i else 0.0 for j in range(len(p))]
    return [0.0] * (len(p) - 1) + [1.0]


def fixture(n=3000, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{i}"          # a third of all rows share one key
        rows.append({
            "unit_id": key,
            "priority": "1-URGENT" if rnd.random() < 0.7 else rnd.choice(["2-HIGH", "3-MEDIUM", "5-LOW", None]),
            "basket": rnd.choice(["small", "medium", "large", None]),
            "segment": rnd.choice(["BUILDING", "MACHINERY", "HOUSEHOLD"]),
            "region": "ASIA", "status": "F",
        })
    return rows


def test_shares_and_segments_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "unit_id string, priority string, basket string, segment string, region string, status string")
    for mode in ("expected", "sampled"):
        probs = [brute_probs(r, mode) for r in rows]
        got = {r.choice: r.total for r in shares.shares(scoring.probabilities(df.repartition(7), RULE, mode=mode), RULE, 9).collect()}
        for i, c in enumerate(RULE.choice_ids):
            assert abs(got[c] - sum(p[i] for p in probs)) < 1e-6
    probs = [brute_probs(r) for r in rows]
    n_all = len(rows)
    overall = [sum(p[i] for p in probs) * 100 / n_all for i in range(3)]
    attrs = shares.segment_attributes(RULE, CAT)
    want = {}
    for k in (1, 2):
        for combo in combinations(attrs, k):
            groups = {}
            for r, p in zip(rows, probs):
                vals = tuple(r[a] for a in combo)
                if all(v in CAT.values(a) for a, v in zip(combo, vals)):
                    g = groups.setdefault(vals, [0, [0.0, 0.0, 0.0]])
                    g[0] += 1
                    g[1] = [x + y for x, y in zip(g[1], p)]
            for vals, (cnt, tot) in groups.items():
                if cnt >= max(50, n_all // 100):
                    for i, c in enumerate(RULE.choice_ids):
                        want[(combo, vals, c)] = (cnt, tot[i] * 100 / cnt - overall[i])
    seg = shares.segments(scoring.probabilities(df, RULE), RULE, CAT, min_abs=50, digits=9).collect()
    got = {}
    for r in seg:
        combo = (r.attr_1,) if r.arity == 1 else (r.attr_1, r.attr_2)
        vals = (r.value_1,) if r.arity == 1 else (r.value_1, r.value_2)
        got[(combo, vals, r.choice)] = (r.n, r.lift_pp)
    assert set(got) == set(want)
    for k, (cnt, lift) in want.items():
        assert got[k][0] == cnt and abs(got[k][1] - lift) < 1e-6


def test_demo_profile_matches_hash_assignment(spark):
    from plurality.sources.profiles import demo_profile

    got = {r.unit_id: r for r in demo_profile(spark, RULE, CAT, 300).collect()}
    assert len(got) == 300
    for i in (0, 1, 7, 299):
        key = f"demo-{i}"
        for a in RULE.needed_attributes():
            vals = CAT.values(a)
            h = int.from_bytes(hashlib.md5(f"{key}:{a}".encode()).digest()[8:16], "little")
            assert got[key][a] == vals[h % len(vals)]
