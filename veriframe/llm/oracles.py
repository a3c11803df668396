"""SQL for the results of operators 6 and 10."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_OP6 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {WORDS} AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(id, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t JOIN c ON c.id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""

ORACLE_OP10 = f"""
WITH t AS (SELECT doc_id, {WORDS} AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM t),
total AS (SELECT count(*) AS n FROM w), k AS (SELECT doc_id, count(*) AS k FROM w GROUP BY 1),
du AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY 1, 2), u AS (SELECT w, sum(c) AS c FROM du GROUP BY 1),
b AS (SELECT a.doc_id, a.w, p.w AS v FROM w a LEFT JOIN w p ON p.doc_id = a.doc_id AND p.i = a.i - 1),
db AS (SELECT doc_id, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY 1, 2, 3), ub AS (SELECT v, w, sum(c) AS c FROM db GROUP BY 1, 2),
x AS (
  SELECT b.doc_id, b.v, CAST(u.c - du.c AS DOUBLE) AS cw, CAST(uv.c - dv.c AS DOUBLE) AS cv, CAST(ub.c - db.c AS DOUBLE) AS cb, CAST(greatest(total.n - k.k, 1) AS DOUBLE) AS rest
  FROM b CROSS JOIN total JOIN k ON k.doc_id = b.doc_id JOIN u ON u.w = b.w JOIN du ON du.doc_id = b.doc_id AND du.w = b.w
  LEFT JOIN u uv ON uv.w = b.v LEFT JOIN du dv ON dv.doc_id = b.doc_id AND dv.w = b.v
  LEFT JOIN ub ON ub.v = b.v AND ub.w = b.w LEFT JOIN db ON db.doc_id = b.doc_id AND db.v = b.v AND db.w = b.w),
y AS (SELECT *, CASE WHEN cw > 0 THEN cw / rest ELSE 0.4 / rest END AS alone FROM x),
z AS (SELECT doc_id, CASE WHEN v IS NULL THEN alone WHEN cb > 0 THEN cb / greatest(cv, 1) ELSE 0.4 * alone END AS value, CASE WHEN cb > 0 THEN 1 ELSE 0 END AS found FROM y),
a AS (SELECT doc_id, count(*) AS n, sum(found) AS found, sum(log10(value)) AS s FROM z GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(found, 0) AS BIGINT) AS pairs_found, round(coalesce(s, 0), 4) AS log10_score, round(s / n, 6) AS mean_log10
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""
