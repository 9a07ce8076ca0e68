"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

from plurality.llm import centroids, jaccard_join, lexical_search, substring_dedup, vector_neighbours
from plurality.llm import quality_rules as q

_WORD = r"[^\x20\x09-\x0D]"


def quality_rules_sql() -> str:
    """op3: metrics with string functions and unnested windows, cutoffs with lgamma."""
    cells = [(rule, i, num, den, c) for rule, (num, den, cuts) in q.RULES.items() for i, c in enumerate(cuts)]
    values = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, i, _, _, c in cells)
    pick = lambda part: " ".join(f"WHEN '{rule}' THEN {spec[part]}" for rule, spec in q.RULES.items())
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{_WORD}+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
win AS (SELECT doc_id, p, array_to_string(list_slice(words, p, p + 7), ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '\\P{{Lu}}', '', 'g'))::BIGINT AS n_capitals, len(lines)::BIGINT AS n_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words AS base_failed FROM m),
rules(rule, place, cutoff) AS (VALUES {values}),
rate AS (SELECT f.doc_id, f.lang, f.base_failed, r.rule, r.place, r.cutoff,
           (CASE r.rule {pick(0)} END)::DOUBLE > r.cutoff * (CASE r.rule {pick(1)} END)::DOUBLE AS broken FROM f, rules r),
good AS (SELECT lang, rule, place, cutoff, count(*) AS n, count(*) FILTER (WHERE broken) AS k FROM rate
         WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
tests AS (SELECT greatest(1, count(DISTINCT coalesce(lang, chr(0)))) * {len(cells)} AS n FROM good),
tail AS (SELECT lang, rule, cutoff, CASE WHEN k >= {q.ALPHA} * n THEN 1.0 ELSE
           (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.ALPHA}) + (n - i) * ln(1 - {q.ALPHA})))
            FROM (SELECT unnest(range(k + 1)) AS i)) END AS p FROM good),
chosen AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tail, tests WHERE p <= {q.DELTA} / tests.n GROUP BY lang, rule),
out AS (SELECT DISTINCT rate.doc_id FROM rate JOIN chosen c ON rate.lang IS NOT DISTINCT FROM c.lang AND rate.rule = c.rule AND rate.cutoff = c.cutoff
        WHERE rate.broken)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept FROM f"""


def warc_sql() -> str:
    """op5: digests of the payloads; the smallest page of equal long ones answers."""
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f"""


def centroid_sql() -> str:
    """op11: every round unrolled; distances from lists, floor division without truncation."""
    c = centroids
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(c.ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, q, n, d FROM (SELECT v.vec_id, v.q, c.n, {far} AS d FROM v, c{r} c)
     QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n) = 1)""")
        if r < c.ROUNDS:
            steps.append(f"""
m{r} AS (SELECT n, list(m ORDER BY i) AS q FROM (SELECT n, i, ((sum(x)::BIGINT - (((sum(x)::BIGINT % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS m
     FROM (SELECT n, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{r}) GROUP BY n, i) GROUP BY n),
c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON c.n = m.n)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({c.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {c.DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {c.K})),
{",".join(steps)}
SELECT vec_id, n::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  (SELECT sha256(array_to_string(c.q, ',')) FROM c{c.ROUNDS} c WHERE c.n = a.n) AS centroid_sha256
FROM a{c.ROUNDS} a"""


def search_sql() -> str:
    """op12: every posting of the items' terms, scored and ranked."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS words FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS nd, sum(len(words))::BIGINT AS nt FROM d),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, nd),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY rank <= {lexical_search.TOP}"""


def neighbours_sql() -> str:
    """op13: all pairs, and what each vector reaches."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {vector_neighbours.THRESHOLD}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a"""


def jaccard_sql() -> str:
    """op6: sets of shingles, all pairs that share one, and what each document reaches."""
    k, percent = jaccard_join.WORDS, jaccard_join.PERCENT
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(list_slice(words, p, p + {k - 1}), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {k - 2})) AS p FROM w WHERE len(words) >= {k})
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND {k - 1})),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a"""


def repeats_sql() -> str:
    """op10: every window, the smallest document that has it, and the words that stay."""
    span = substring_dedup.SPAN
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words FROM documents),
v AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(list_slice(words, p, p + {span - 1}), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {span - 2})) AS p FROM w WHERE len(words) >= {span})),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, p + o AS i FROM (SELECT v.doc_id, v.p FROM v JOIN f ON v.h = f.h WHERE first < doc_id), (SELECT unnest(range({span})) AS o)),
words AS (SELECT doc_id, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id"""


ORACLE = {
    "op3_quality_rules": quality_rules_sql(),
    "op5_warc": warc_sql(),
    "op6_jaccard_join": jaccard_sql(),
    "op10_substring_dedup": repeats_sql(),
    "op11_centroid_clustering": centroid_sql(),
    "op12_ranked_search": search_sql(),
    "op13_vector_neighbours": neighbours_sql(),
}
