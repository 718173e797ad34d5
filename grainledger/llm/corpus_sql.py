"""DuckDB SQL that gives the rows of op4, op7 and op9 by their definitions: all windows, all pairs of vectors, all pairs that share a shingle."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_REACH = """
reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

OP4 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM g JOIN f USING (k) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS said FROM p WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = p.doc_id AND gone.p = p.p) GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),{_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component AS component_id, component = d.doc_id AS kept FROM documents d JOIN least ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP7 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings),{_REACH}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, component AS component_id, component = e.vec_id AS kept FROM embeddings e JOIN least ON id = e.vec_id
"""
