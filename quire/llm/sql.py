"""DuckDB SQL with the same rows as the queries that SQL can express."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""

EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

URL_FILTERS = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), own AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), cut AS (
  SELECT *, list_reverse(string_split(host, '.')) AS labels,
         list_filter(string_split(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '/'), lambda s: s <> '') AS parts,
         regexp_extract(path, '\.([A-Za-z0-9]{1,8})$', 1) AS ending, regexp_extract(rest, '\?([^#]*)', 1) AS query
  FROM own
), tokened AS (
  SELECT page_id, host, path, list_sort(list_distinct(list_filter(list_concat(list_concat(
    CASE WHEN host <> '' THEN list_transform(range(1, len(labels) + 1), lambda n: 'h' || n || '=' || array_to_string(list_reverse(labels[1:n]), '.')) ELSE [] END,
    list_transform(range(1, len(parts) + 1), lambda i: 'p' || i || '=' || parts[i])),
    [CASE WHEN ending <> '' THEN 'x=' || translate(ending, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END,
     CASE WHEN query <> '' THEN 'q=' || array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)))), '&') END]
  ), lambda x: x IS NOT NULL))) AS tokens
  FROM cut
), bad AS (
  SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), t AS (
  SELECT row_number() OVER () AS id, tokens, bad FROM tokened JOIN bad ON try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) AS BIGINT) = doc_id WHERE len(tokens) > 0 OR bad
), least AS (SELECT ceil(0.02::DOUBLE * count(*)) AS n FROM t),
frequent AS (SELECT a FROM (SELECT bad, unnest(tokens) AS a FROM t) GROUP BY a HAVING count(*) FILTER (bad) >= (SELECT n FROM least)),
one AS (SELECT id, bad, a FROM (SELECT id, bad, unnest(tokens) AS a FROM t) SEMI JOIN frequent USING (a)),
sets AS (
  SELECT id, bad, a, [a] AS rule FROM one
  UNION ALL SELECT s.id, s.bad, o.a, list_append(s.rule, o.a) FROM sets s JOIN one o ON s.id = o.id AND o.a > s.a
), rules AS (
  SELECT rule, count(*) FILTER (bad) / count(*)::DOUBLE AS confidence FROM sets GROUP BY rule
  HAVING count(*) FILTER (bad) >= (SELECT n FROM least) AND count(*) FILTER (bad) > 0 AND count(*) FILTER (bad) / count(*)::DOUBLE >= 0.6::DOUBLE
), listed(kind, own_host, own_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), judged AS (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': own_host || own_path, 'kind': kind}, length(own_host || own_path)) FROM listed
     WHERE (host = own_host OR ends_with(host, '.' || own_host)) AND starts_with(path, own_path)) AS l,
    (SELECT max(confidence) FROM rules WHERE list_has_all(tokens, rule)) AS confidence
  FROM tokened
)
SELECT page_id, host, path, l.rule AS rule, coalesce(l.kind, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN l IS NULL THEN confidence END AS confidence
FROM judged
"""

ORACLES = {
    "op1_url_filters": URL_FILTERS,
    "op6_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op9_exact_top_k": TOP_K,
}
