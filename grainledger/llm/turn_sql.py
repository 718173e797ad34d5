"""DuckDB SQL that gives the rows of the queries over conversations, by plain definitions instead of the operators' methods."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string."""
    byte = "list_reduce(list_prepend(xor(c, x), [0, 1, 2, 3, 4, 5, 6, 7]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    # only the low byte of xor(c, x) meets the table in the usual form; bit by bit the whole register is shifted
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {byte}), 4294967295)"


OP11 = f"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, '')))::BIGINT AS b
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {crc32("conv_id::VARCHAR")} % 9 AS h FROM o GROUP BY conv_id),
l AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(d.n, 0)) AS lent FROM c LEFT JOIN c d ON c.base = d.conv_id),
r AS (SELECT l.conv_id, o.k, o.b, o.pos FROM l JOIN o ON o.conv_id = l.base AND o.pos < l.h
  UNION ALL SELECT l.conv_id, o.k, o.b, o.pos - l.h + l.lent FROM l JOIN o ON o.conv_id = l.conv_id AND o.pos >= l.h),
p AS (SELECT conv_id, pos + 1 AS depth, b, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM e GROUP BY depth, path),
ch AS (SELECT a.path, count(d.path) AS n_children, min(up.conv_id) AS parent FROM n a LEFT JOIN n d ON d.depth = a.depth + 1 AND left(d.path, length(a.path)) = a.path
  LEFT JOIN n up ON up.depth = a.depth - 1 AND up.path = left(a.path, greatest(length(a.path) - 64, 0)) GROUP BY a.path),
sub AS (SELECT a.path, count(*) FILTER (WHERE ch.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.b) AS saved FROM n a JOIN n d ON d.depth >= a.depth AND left(d.path, length(a.path)) = a.path JOIN ch ON ch.path = d.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, ch.parent AS parent_conv_id, n.n_convs, ch.n_children, sub.n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN ch USING (path) JOIN sub USING (path)
"""


def _op13() -> str:
    add = lambda c, e, s: f"(printf('%09d', left({s}, 9)::BIGINT + {c}) || '{e}' || substr({s}, 10))"
    closed = lambda g: [f"least({g[0]}, {add(10, 'II', g[3])}, {add(5, 'I', g[2])})", f"least({g[1]}, {add(10, 'II', g[3])}, {add(5, 'I', g[2])})", f"least({g[2]}, {add(5, 'I', g[3])})", f"least({g[3]}, {add(5, 'I', g[2])})"]
    never = "'900000000'"
    first = closed(["'000000000'", never, never, "'000000000'"])
    keep = {0: f"CASE i WHEN 's' THEN {add('x', 'K', 's1')} WHEN 'u' THEN {add('x', 'K', 's2')} ELSE {never} END", 2: f"CASE i WHEN 'a' THEN {add('x', 'K', 's3')} ELSE {never} END"}
    keep[1] = keep[3] = f"CASE i WHEN 'u' THEN {add('x', 'K', 's2')} ELSE {never} END"
    step = [f"CASE WHEN fault IN (1, 2) THEN {add(2, 'D', f's{q}')} ELSE least({add(2, 'D', f's{q}')}, {keep[q]}, {add('x + 1', 'R', 's3' if q == 2 else 's2')}) END" for q in range(4)]
    at = lambda exprs, names: ", ".join(f"{e} AS {n}{q}" for q, e in enumerate(exprs) for n in [names])
    return rf"""
WITH RECURSIVE d AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
f AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM d WHERE fate <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos FROM f),
m AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM m),
a AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM g GROUP BY conv_id),
w AS (SELECT conv_id, n AS pos, {at(first, 's')} FROM a
  UNION ALL SELECT conv_id, pos, {at(closed([f"g{q}" for q in range(4)]), 's')}
  FROM (SELECT conv_id, pos - 1 AS pos, {at(step, 'g')} FROM (SELECT w.*, m.i, m.fault, CASE m.fault WHEN 3 THEN 5 ELSE 0 END AS x FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos))),
u AS (SELECT conv_id, left(s0, 9)::BIGINT AS cost, substr(s0, 10) AS audit FROM w WHERE pos = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS j FROM u WHERE audit <> ''),
q AS (SELECT e.*, count(*) FILTER (WHERE e.e <> 'I') OVER (PARTITION BY e.conv_id ORDER BY j) AS pos, count(*) FILTER (WHERE e.e <> 'D') OVER (PARTITION BY e.conv_id ORDER BY j) AS k FROM e),
v AS (SELECT q.conv_id, q.j, q.k, q.e, m.role, m.text, max(CASE WHEN q.k = 1 AND q.e = 'K' AND m.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS has_s
  FROM q LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM q.conv_id AND m.pos = q.pos AND q.e <> 'I' WHERE q.e <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM v GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM every LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN u ON u.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM every.conv_id
"""


OP13 = _op13()
