"""The same results as SQL for DuckDB, written from the definitions."""
from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[pos:pos + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS pos FROM i WHERE len(w) > 0)),
g AS (
  SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos
        FROM d, (SELECT DISTINCT n FROM p))),
o AS (SELECT DISTINCT r, item, g.n, pos FROM g JOIN p USING (phrase)),
h AS (SELECT r, count(DISTINCT pos + k) AS n_hit
      FROM (SELECT r, pos, unnest(range(n)) AS k FROM o) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""

OP7 = r"""
WITH s AS (
  SELECT doc_id, source, md5('7:' || doc_id::VARCHAR) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
        row_number() OVER (ORDER BY source NULLS LAST) AS n FROM t),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS full_at FROM w),
f AS (SELECT *, (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM t) AS total,
        coalesce(sum(cap) OVER (ORDER BY full_at, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(w) OVER (ORDER BY full_at, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c),
l AS (SELECT (total - below) / rest AS level FROM f WHERE (total - below) / rest < full_at
      ORDER BY full_at, n LIMIT 1),
a AS (SELECT source, source_size,
        CASE WHEN (SELECT level FROM l) IS NULL OR full_at <= (SELECT level FROM l) THEN cap
             ELSE w * (SELECT level FROM l) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM a),
u AS (SELECT source, k, sum(size) AS size FROM s GROUP BY source, k),
v AS (SELECT source, k, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
x AS (SELECT v.source, k, before + v.size / 2.0::DOUBLE < target - whole * source_size AS more
      FROM v JOIN e ON v.source IS NOT DISTINCT FROM e.source)
SELECT s.doc_id, s.size, e.source_size, e.target,
  (s.size * (whole + more::INT))::BIGINT AS taken
FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source
JOIN x ON s.source IS NOT DISTINCT FROM x.source AND s.k = x.k
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, coalesce(role = 'assistant', false) AS learned,
        length(text) + length(text) - length(replace(text, '\', ''))
        + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+'))
        + (length(text) - length(replace(text, '</turn>', ''))) / 7 AS text_chars,
        length(role) + length(role) - length(replace(role, '\', ''))
        + length(role) - length(replace(role, '#', '')) - len(regexp_extract_all(role, '#+'))
        + (length(role) - length(replace(role, '</turn>', ''))) / 7
        + length(role) - length(replace(role, ':', '')) AS role_chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE learned), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE learned), '')) AS loss_sha256,
  sum(role_chars + text_chars + 14)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)
    AND list_max([abs(x) FOR x IN embedding]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links,
  coalesce(component_id, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component_id, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.n = e.vec_id
"""

OP11 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""
