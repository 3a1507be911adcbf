"""SQL of the queries of this subpackage that SQL can express: exact neighbours and near-duplicates by brute force.

The other queries rest on alignment, learned weights, dictionaries of typed forms, or byte-pair merges; tests
compare them with brute force, a public library, or held-out cases.
"""

from __future__ import annotations

_WORDS = """w AS (SELECT arxiv_id AS id, list_distinct(regexp_extract_all(lower(coalesce(title, '') || chr(10) || abstract), '[\\p{L}\\p{N}\\p{M}_]+')) AS ws FROM papers WHERE arxiv_id IS NOT NULL AND regexp_matches(abstract, '[\\p{L}\\p{N}_]')),
u AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM w),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM u a JOIN u b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id)"""

P5 = f"WITH {_WORDS} SELECT a AS arxiv_id_a, b AS arxiv_id_b FROM shared WHERE common / (na + nb - common) > 0.65"

P5_CLASSES = f"""WITH {_WORDS.split("u AS")[0]}g AS (SELECT list_sort(ws) AS s, min(id) AS class, count(*) AS copies FROM w GROUP BY 1),
u AS (SELECT class, len(s) AS n, unnest(s) AS word FROM g),
near AS (SELECT a.class AS a, b.class AS b FROM u a JOIN u b ON a.word = b.word AND a.class < b.class GROUP BY a.class, b.class HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.65),
l AS (SELECT class, count(*) AS links FROM (SELECT a AS class FROM near UNION ALL SELECT b FROM near) GROUP BY class)
SELECT w.id, g.class, g.copies, coalesce(l.links, 0) AS links FROM w JOIN g ON list_sort(w.ws) = g.s LEFT JOIN l ON l.class = g.class"""

P4 = """WITH v AS (SELECT arxiv_id AS id, vector::DOUBLE[] AS x FROM papers WHERE arxiv_id IS NOT NULL AND has_embedding AND len(vector) = 768),
s AS (SELECT a.id, b.id AS other, round(coalesce(nullif(list_cosine_similarity(a.x, b.x), 'nan'::DOUBLE), 0.0), 6) AS c FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT id, other FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, other) <= 5)
SELECT DISTINCT least(id, other) AS arxiv_id_a, greatest(id, other) AS arxiv_id_b FROM k"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"p4_found": P4, "p5_found": P5, "p5_classes": P5_CLASSES}
