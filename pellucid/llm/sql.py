"""DuckDB SQL for the training-data queries that SQL can express."""

from pellucid.llm.license import LEAST, SHINGLE, TEMPLATES


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEMPLATES.items())
    cut = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = f"list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))"
    return f"""
WITH t AS (SELECT template_id, unnest({grams}) AS g FROM (SELECT template_id, {cut("text")} AS w FROM (VALUES {values}) AS v(template_id, text))),
n AS (SELECT template_id, count(*)::BIGINT AS total FROM t GROUP BY 1),
d AS (SELECT DISTINCT doc_id, th, unnest({grams}) AS g FROM (SELECT doc_id, md5(text) AS th, {cut("text")} AS w FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, th, template_id, count(*)::BIGINT AS matched FROM d JOIN t USING (g) GROUP BY 1, 2, 3)
SELECT doc_id, template_id, matched, total, round(matched / total, 6) AS containment FROM m JOIN n USING (template_id) WHERE matched >= {LEAST} * total"""


ORACLE = {
    "op3_license_scan": _license_sql(),
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20""",
}

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

ORACLE["op11_filter_audit"] = f"""
WITH w AS (SELECT doc_id, part, t, {_WORDS} AS w FROM (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t FROM documents)),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
g AS (SELECT part, fails, count(*) AS n, sum(COALESCE(good, 0)) AS good, sum(COALESCE(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, f, COALESCE(sum(n) FILTER (translate(fails, earlier || f, '') = fails), 0) AS kept,
    COALESCE(sum(n) FILTER (gone), 0) AS removed, COALESCE(sum(n) FILTER (contains(fails, f) AND NOT gone), 0) AS redundant, COALESCE(sum(n) FILTER (fails = f), 0) AS unique_fails,
    COALESCE(sum(good) FILTER (gone), 0) AS good_lost, COALESCE(sum(toxic) FILTER (gone), 0) AS toxic_lost
  FROM (SELECT *, contains(fails, f) AND translate(fails, earlier, '') = fails AS gone FROM g, s) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

ORACLE["op13_line_dedup"] = r"""
WITH l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY 1 HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, gone.key IS NOT NULL AS dropped FROM k LEFT JOIN gone ON k.key = gone.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""

ORACLE["op12_collocations"] = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 6) s(size) WHERE len(w) >= size)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100 OR size = 1),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a FROM (
    SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS i FROM c, range(2, 5) s(k) WHERE k < size)),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cuts AS (SELECT kept.lang, kept.phrase, a, k, h.f AS l, t.f AS r, n.n, 1000 * a::HUGEINT * n.n // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) kept
  JOIN f h ON h.lang = kept.lang AND h.phrase = array_to_string(kept.w[1:k], ' ') JOIN f t ON t.lang = kept.lang AND t.phrase = array_to_string(kept.w[k + 1:kept.size], ' ') JOIN n ON n.lang = kept.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low) WHERE rank <= 2000"""
