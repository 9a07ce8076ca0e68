"""Quality rules with risk-controlled cutoffs (DataFrame expressions only).

Base rules have fixed limits. The learned rules compare a rate of the text
with a cutoff per stratum (language). A cutoff is used only if labelled good
documents of that stratum prove it harmless: with ``k`` of ``n`` good
documents rejected, the exact binomial probability P(Bin(n, alpha) <= k) must
be at most ``delta`` divided by the number of (rule, stratum, cutoff) tests
(Bonferroni). So with probability 1 - delta every cutoff in use rejects at
most a share ``alpha`` of good documents of its stratum. The strictest proven
cutoff of a rule is taken; a stratum with too few labels has none.

Cases: null text counts as empty (no words, base_failed); a null language is a
stratum of its own; null or repeated labels: a document is good if some label
row says quality 1; repeated documents are scored row by row; an empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut

SPACE = "[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
ALPHA = 0.002
DELTA = 0.05
BROADCAST_STRATA = 10_000
#: rule -> (numerator, denominator, candidate cutoffs); a document breaks the rule above the cutoff
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)),
    "capitals": ("n_capitals", "word_chars", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6)),
}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]


def with_metrics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` plus one struct column ``_m`` of METRICS, per row, without a shuffle.

    ``n_repeat_words`` works on 64-bit hashes of the 8-word windows: they are
    sorted together with their positions, equal neighbours are the repeated
    windows, and the covered words are summed from the gaps between their
    positions. Only texts with a repeated window pay for the sort.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*[F.col(c) for c in keep], t.alias("_t"))
    base = base.withColumns({
        "_w": F.array_remove(F.split("_t", SPACE + "+"), ""),
        "_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")),
        "_c": F.length("_t") - F.regexp_count("_t", F.lit(SPACE)),
        "_s": F.regexp_count("_t", F.lit(SYMBOLS)),
        "_u": F.regexp_count("_t", F.lit("\\p{Lu}")),
    })
    n = F.size("_w")
    # window hashes by doubling: pairs of words, of pairs, of fours; the last WINDOW - 1 entries hang over the end
    base = base.withColumn("_h", F.expr("transform(_w, x -> xxhash64(x))"))
    for step in (1, 2, 4):
        base = base.withColumn("_h", F.expr(f"zip_with(_h, slice(_h, {step + 1}, size(_h)), (a, b) -> xxhash64(a, b))"))
    base = base.withColumn("_h", F.expr(f"if(size(_w) >= {WINDOW}, slice(_h, 1, size(_w) - {WINDOW - 1}), null)"))
    m = F.size("_h")
    base = base.withColumn("_b", F.when(F.size(F.array_distinct("_h")) < m, F.ceil(F.log2(m + 1)).cast("int")))
    # hash prefix and position share one long, so a primitive sort groups equal windows
    mask = F.expr("shiftleft(1L, _b) - 1")
    base = base.withColumn("_k", F.expr("sort_array(transform(if(_b is null, null, _h), (h, i) -> shiftleft(shiftright(h, _b), _b) | i))"))
    base = base.withColumn("_mask", mask)
    same = "_h[cast({0} & _mask as int)] = _h[cast({1} & _mask as int)]"
    base = base.withColumn("_p", F.expr(
        "sort_array(transform(filter(_k, (x, i) -> "
        f"(i > 0 and {same.format('x', 'get(_k, i - 1)')}) or (i < size(_k) - 1 and {same.format('x', 'get(_k, i + 1)')})"
        "), x -> x & _mask))"))
    repeat = F.expr(
        f"coalesce(aggregate(transform(_p, (p, i) -> if(i = size(_p) - 1, {WINDOW}L, least({WINDOW}L, get(_p, i + 1) - p))),"
        " 0L, (a, x) -> a + x), 0L)")
    long = lambda c: c.cast("long")
    return base.select(*keep, F.struct(
        long(n).alias("n_words"),
        long(F.col("_c")).alias("word_chars"),
        long(F.col("_s")).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        long(F.col("_u")).alias("n_capitals"),
        long(F.size("_l")).alias("n_lines"),
    ).alias("_m"))


def base_failed(m: str = "_m") -> Column:
    w, r = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (w < MIN_WORDS) | (100 * r > MAX_REPEAT_PCT * w)


def _breaks(rule: str, cutoff: Column, m: str = "_m") -> Column:
    num, den, _ = RULES[rule]
    return F.col(f"{m}.{num}").cast("double") > cutoff * F.col(f"{m}.{den}").cast("double")


def log_factorial(x: Column) -> Column:
    """ln(x!): exact product up to 20, Stirling's series with three correction terms beyond (error below 1e-11)."""
    d = x.cast("double")
    y = d + 1.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), summed downwards from k until terms no longer count; 1 where k is at or above the mean."""
    p = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k)
              + k * F.log(F.lit(alpha)) + (n - k) * F.log(F.lit(1 - alpha)))
    terms = F.least(k, F.ceil(40 * F.sqrt(n.cast("double")) + 60).cast("long"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda a, j: F.struct(
            (a["s"] + a["t"]).alias("s"),
            (a["t"] * (k - j).cast("double") * (1 - alpha) / ((n - k + j + 1).cast("double") * alpha)).alias("t")),
        lambda a: a["s"],
    )
    return F.when(k.cast("double") >= alpha * n, F.lit(1.0)).otherwise(p * total)


def choose_cutoffs(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the strictest proven cutoff of each rule, null if none.

    ``good``: metrics of the labelled good documents that pass the base rules.
    One partial aggregation counts all (rule, cutoff) rejections per stratum.
    """
    counts = good.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("n"), *[
        F.count(F.when(_breaks(r, F.lit(c)), 1)).alias(f"k_{r}_{i}")
        for r, (_, _, cuts) in RULES.items() for i, c in enumerate(cuts)])
    counts = cut(counts)
    tests = max(1, counts.count()) * sum(len(c) for _, _, c in RULES.values())
    picked = []
    for r, (_, _, cuts) in RULES.items():
        proven = [F.when(binomial_tail(F.col("n"), F.col(f"k_{r}_{i}"), alpha) <= delta / tests, F.lit(c))
                  for i, c in enumerate(cuts)]
        picked.append(F.coalesce(*proven).alias(f"cut_{r}"))
    return counts.select("_stratum", *picked)


def verdicts(metrics: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """Adds base_failed and kept. ``cutoffs`` has one row per stratum and is broadcast up to BROADCAST_STRATA rows."""
    side = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs
    j = metrics.join(side, stratum.eqNullSafe(F.col("_stratum")), "left")
    broken = [F.coalesce(_breaks(r, F.col(f"cut_{r}")), F.lit(False)) for r in RULES]
    any_broken = broken[0]
    for b in broken[1:]:
        any_broken = any_broken | b
    return (j.withColumn("base_failed", base_failed())
            # one comparison over both sides: a conjunction would be pushed below the join and repeat the metrics
            .withColumn("kept", F.col("base_failed").cast("int") + any_broken.cast("int") == 0)
            .drop("_stratum", *[f"cut_{r}" for r in RULES]))


def fit(metrics: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Cutoffs from the labelled good documents in ``metrics`` (id, stratum, _m)."""
    good_ids = labels.filter(F.col("quality") == 1).select(F.col(id_col)).distinct()
    good = metrics.join(good_ids, id_col, "left_semi").filter(~base_failed())
    return choose_cutoffs(good, stratum)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Per document: id, the metrics, base_failed, kept."""
    # texts are read once; what both passes need is a few numbers per document
    metrics = cut(with_metrics(docs, text, [id_col, stratum]))
    out = verdicts(metrics, fit(metrics, labels, id_col, stratum), F.col(stratum))
    return out.select(id_col, *[F.col(f"_m.{c}").alias(c) for c in METRICS], "base_failed", "kept")


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Cutoffs come from a
    first pass over the texts; the second computes each verdict in place, so
    texts are not shuffled.
    """
    cutoffs = fit(cut(with_metrics(docs.select("doc_id", "text", "lang"), "text", ["doc_id", "lang"])), labels)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    judged = verdicts(with_metrics(rows, "_text", ["_row"]), cutoffs, F.col("_row.lang"))
    return judged.filter("kept").select("_row.*")


def op3_quality_rules(spark, sf_dir):
    from plurality.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
