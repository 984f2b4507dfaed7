"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLOSURE = """reach AS (SELECT id, id AS begun FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.begun = l.a)"""

ORACLES = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src FROM documents),
k AS (SELECT *, md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || size) AS key FROM d),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY src),
r AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 AS place FROM s),
w AS (SELECT *, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY full_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_at, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN level <= full_at THEN level END) OVER () * weight, cap)) AS target FROM l),
a AS (SELECT k.*, source_size, target, place, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM k JOIN t USING (src)),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS demand, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM a),
q AS (SELECT *, demand - passes * source_size AS rest, least(CAST(begun AS DOUBLE) / greatest(target, 1.0), 1.0) AS x FROM p)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - begun)) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND (passes > 0 OR rest > begun) THEN round(least(CASE WHEN x <= 0 THEN 0.0
    WHEN place = 0 THEN 2.0 * x / (1.0 + sqrt(1.0)) WHEN place = 1 THEN 2.0 * x / (0.5 + sqrt(0.25 + 2.0 * x)) ELSE 2.0 * x / (1.5 + sqrt(greatest(2.25 - 2.0 * x, 0.0))) END, 1.0), 9) END AS position
FROM q""",
    "op2_compact_shards": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, source, lang, n_chars FROM documents",
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT id FROM v),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id AND list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98),
{_CLOSURE}
SELECT c.id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = c.id AS kept
FROM (SELECT id, min(begun) AS component_id FROM reach GROUP BY id) c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.id""",
    "op6_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents), nodes AS (SELECT id FROM d),
sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
{_CLOSURE}
SELECT c.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = c.id AS kept FROM (SELECT id, min(begun) AS component_id FROM reach GROUP BY id) c LEFT JOIN n ON n.id = c.id""",
    "op8_decontaminate": rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
m AS (SELECT doc_id, item_id, n, i FROM dg JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_url_rules": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, pre, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(action, length(h || pre)) AS action FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, pre) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action
  WHEN regexp_matches(host || path, '^(?:[^/]*\.)?(?:spam-farm\.|cheap-pills\.|www\.cheap-pills\.|free-casino\.|adult-)') OR regexp_matches(host || path, '/casino/.*/bonus(?:[^A-Za-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN best USING (page_id)""",
    "op11_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op12_source_audit": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL), l AS (SELECT lang, term, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL), ls AS (SELECT lang, sum(n) AS n FROM l GROUP BY lang),
dense AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + CAST((coalesce(c.n, 0) + 5) * 1000000000::HUGEINT // (coalesce(s.n, 0) + 5 * v) AS BIGINT) AS p, 1 + CAST((l.n + 5) * 1000000000::HUGEINT // (ls.n + 5 * v) AS BIGINT) AS q
  FROM groups JOIN k USING (lang) JOIN v USING (lang) JOIN l USING (lang, term) JOIN ls USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT x.lang, x.source, y.source AS item, CAST(coalesce(sum(abs(a.p - b.p)), 0) AS BIGINT) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN dense a ON a.lang = x.lang AND a.source = x.source LEFT JOIN dense b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 50""",
}
