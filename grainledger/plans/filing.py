"""Queries over filings that are built from the documents, so that it is known where their sections stand.

FILING documents make one filing of one of eight shapes: headings on lines of their own or inside lines, contents in front, a section
that is incorporated by reference, one that is missing, mentions in sentences, a repeated heading, an empty section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.operators import sections
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


FILING = 40
#: Last document (of FILING) of each body, and the place of the body among the parts.
BODIES = {20: 9, 40: 21, 60: 24, 80: 34, 100: 39}

_HEADS = {10: ("1", "\nITEM 1. BUSINESS", " OF THE COMPANY\n"), 30: ("1A", "\nItem 1A. Risk", " Factors\n"), 50: ("1B", "\nITEM 1B. UNRESOLVED", " STAFF COMMENTS\n"), 70: ("7", "\nItem 7. Management", "'s Discussion\n"), 90: ("8", "\nITEM 8. FINANCIAL", " STATEMENTS\n")}
_INLINE = {k: (i, " | " + lead[1:], tail[:-1] + " | ") for k, (i, lead, tail) in _HEADS.items()}
_CONTENTS = {1: ("1", "Item 1. Business", " ......... 4\n"), 2: ("1A", "Item 1A. Risk", " Factors ......... 9\n"), 3: ("1B", "Item 1B. Unresolved", " ......... 11\n"), 4: ("7", "Item 7. Management", " ......... 20\n"), 5: ("8", "Item 8. Financial", " ......... 30\n")}
_REFERENCE = " is incorporated by reference to Exhibit 13 of this report.\n"
_SHAPES = [
    _HEADS,
    _INLINE,
    _CONTENTS | _HEADS,
    _HEADS | {70: ("7", "\nItem 7. Management", "'s Discussion" + _REFERENCE)},
    {k: v for k, v in _HEADS.items() if k != 30},
    _HEADS | {11: ("7", "\nas described in Item 7.", "of this report, "), 31: ("8", "\npursuant to Item 8.", "hereof, "), 50: ("2", "\nItem 2. Properties", "\n")},
    _HEADS | {25: ("1", "\nITEM 1. BUSINESS", " OF THE COMPANY\n")},
    _HEADS,
]
#: Bodies that a shape hasn't.
_LACKS = {(3, 80), (7, 20)}
_PARTS = [(shape, place, item, lead, tail, lead[: lead.lower().index("item")].strip().endswith("in") or "pursuant" in lead, ("....." in tail), (len(tail) - len(tail.split("reference", 1)[1]) if "reference" in tail else None)) for shape, parts in enumerate(_SHAPES) for place, (item, lead, tail) in parts.items()]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing, text: documents of a filing in order with the shape's headings between them, each text on a line."""
    docs = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {FILING}").alias("filing"), (F.col("doc_id") % FILING).alias("slot"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = F.lit(None).cast("int")
    for at, last in reversed(BODIES.items()):
        place = F.when(F.col("slot") <= last, at).otherwise(place)
    bodies = docs.select("filing", place.alias("place"), "doc_id", F.concat("text", F.lit("\n")).alias("part"))
    # the middle of the first body, where a repeated heading stands
    bodies = bodies.withColumn("place", F.when((F.col("place") == 20) & (F.col("doc_id") % FILING > 4), 27).otherwise(F.col("place")))
    gone = F.lit(False)
    for shape, at in sorted(_LACKS):
        gone = gone | ((F.col("filing") % len(_SHAPES) == shape) & F.col("place").isin(at, at + 7))
    bodies = bodies.where(~gone)
    heads = spark.createDataFrame([(s, p, lead + tail) for s, p, _, lead, tail, *_ in _PARTS], "shape int, place int, part string")
    ids = docs.select("filing").distinct().withColumn("shape", (F.col("filing") % len(_SHAPES)).cast("int"))
    lines = ids.join(F.broadcast(heads), "shape").select("filing", "place", F.lit(-1).cast("long").alias("doc_id"), "part")
    parts = bodies.unionByName(lines).groupBy("filing").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "part"))).alias("parts"))
    return parts.select("filing", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def _known() -> str:
    """SQL of the filings' sections from the lengths of their parts alone."""
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    values = ", ".join(f"({s}, {p}, '{i}', {quoted(lead)}, {quoted(tail)}, {r}, {d}, {'NULL' if e is None else e})" for s, p, i, lead, tail, r, d, e in _PARTS)
    place = "CASE " + " ".join(f"WHEN doc_id % {FILING} <= {last} THEN {at}" if at != 20 else f"WHEN doc_id % {FILING} <= 4 THEN 20 WHEN doc_id % {FILING} <= {last} THEN 27" for at, last in BODIES.items()) + " END"
    lacks = " OR ".join(f"(filing % {len(_SHAPES)} = {s} AND place IN ({at}, {at + 7}))" for s, at in sorted(_LACKS))
    floor, span = sections.FLOOR, sections.CONTENTS_SPAN
    rungs = " ".join(f"WHEN '{item}' THEN {k}" for ends, _ in sections.ENDS.values() for k, item in enumerate(ends))
    good = " ".join(f"WHEN '{i}' THEN {v}" for i, v in sections.GOOD.items())
    proper = " ".join(f"WHEN '{i}' THEN {n}" for i, (_, n) in sections.ENDS.items())
    return f"""
heads(shape, place, item, lead, tail, refers, leader, reference_end) AS (VALUES {values}),
bodies AS (SELECT * FROM (SELECT doc_id // {FILING} AS filing, {place} AS place, doc_id, coalesce(text, '') || chr(10) AS part FROM documents) WHERE NOT ({lacks})),
parts AS (SELECT filing, place, doc_id, part, NULL AS item, NULL AS lead, false AS refers, false AS leader, NULL AS reference_end FROM bodies
  UNION ALL SELECT filing, place, -1, lead || tail, item, lead, refers, leader, reference_end FROM (SELECT DISTINCT doc_id // {FILING} AS filing FROM documents) JOIN heads ON shape = filing % {len(_SHAPES)}),
laid AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY filing ORDER BY place, doc_id) AS BIGINT) - length(part) AS spot FROM parts),
whole AS (SELECT filing, string_agg(part, '' ORDER BY place, doc_id) AS text, CAST(sum(length(part)) AS BIGINT) AS n FROM parts GROUP BY filing),
h AS (SELECT filing, item, spot + position('item' IN lower(lead)) - 1 AS spot, spot + length(lead) AS start, refers, leader, reference_end FROM laid WHERE item IS NOT NULL),
k AS (SELECT a.*, (SELECT count(DISTINCT b.item) FROM h b WHERE b.filing = a.filing AND NOT b.refers AND b.spot >= a.spot AND b.spot + 5 + length(b.item) <= a.spot + {span}) >= 4 AS cluster FROM h a),
ok AS (SELECT * FROM k WHERE NOT (cluster OR leader OR refers) AND item IN ('1', '1A', '7')),
ends AS (SELECT a.filing, a.spot, a.item, b.spot AS stop, b.item AS end_item, CASE b.item {rungs} END AS rung FROM ok a JOIN h b ON a.filing = b.filing AND NOT b.refers AND b.spot > a.start
  AND ((a.item = '1A' AND b.item IN ('1B', '1C', '2')) OR (a.item = '7' AND b.item IN ('7A', '8')))),
spans AS (SELECT ok.*, coalesce(e.stop, n) AS stop, e.end_item, e.rung FROM ok JOIN whole USING (filing) LEFT JOIN (SELECT filing, spot, min_by(end_item, stop) AS end_item, min_by(rung, stop) AS rung, min(stop) AS stop FROM ends GROUP BY filing, spot) e ON e.filing = ok.filing AND e.spot = ok.spot),
triples AS (SELECT a.filing, a.spot AS a1, b.spot AS a2, c.spot AS a3, a.start AS s1, b.start AS s2, c.start AS s3, b.stop AS e2, c.stop AS e3, b.end_item AS i2, c.end_item AS i3, b.rung AS r2, c.rung AS r3, a.reference_end AS x1, b.reference_end AS x2, c.reference_end AS x3
  FROM spans a JOIN spans b ON a.filing = b.filing AND b.spot > a.spot JOIN spans c ON c.filing = a.filing AND c.spot > b.spot WHERE a.item = '1' AND b.item = '1A' AND c.item = '7'
  AND (b.spot - a.start >= {floor} OR coalesce(a.reference_end <= b.spot - a.start, false)) AND (b.stop - b.start >= {floor} OR coalesce(b.reference_end <= b.stop - b.start, false)) AND (c.stop - c.start >= {floor} OR coalesce(c.reference_end <= c.stop - c.start, false))),
best AS (SELECT *, count(*) OVER (PARTITION BY filing) AS ways FROM triples QUALIFY row_number() OVER (PARTITION BY filing ORDER BY a1, a2, a3) = 1),
toc AS (SELECT filing, coalesce(max(k.spot) FILTER (WHERE cluster AND item IN ('1', '1A', '7') AND k.spot <= {sections.FRONT} * n), -1) AS last FROM whole LEFT JOIN k USING (filing) GROUP BY filing),
items(item) AS (VALUES ('1'), ('1A'), ('7')),
rows AS (SELECT w.filing, i.item, ways, text, n, last, (SELECT count(*) FROM ok WHERE ok.filing = w.filing AND ok.item = i.item) AS candidates,
    CASE i.item WHEN '1' THEN a1 WHEN '1A' THEN a2 ELSE a3 END AS spot, CASE i.item WHEN '1' THEN s1 WHEN '1A' THEN s2 ELSE s3 END AS start, CASE i.item WHEN '1' THEN a2 WHEN '1A' THEN e2 ELSE e3 END AS stop,
    CASE i.item WHEN '1' THEN x1 WHEN '1A' THEN x2 ELSE x3 END AS x, CASE i.item WHEN '1' THEN CASE WHEN ways > 0 THEN '1A' END WHEN '1A' THEN i2 ELSE i3 END AS end_item, CASE i.item WHEN '1' THEN CASE WHEN ways > 0 THEN 0 END WHEN '1A' THEN r2 ELSE r3 END AS rung
  FROM whole w CROSS JOIN items i LEFT JOIN best USING (filing) JOIN toc ON toc.filing = w.filing),
measured AS (SELECT *, stop - start AS length, length(regexp_replace(substr(text, start + 1, stop - start), '[^\\p{{L}}]', '', 'g')) / greatest(length(regexp_replace(substr(text, start + 1, stop - start), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]', '', 'g')), 1) AS alpha FROM rows),
judged AS (SELECT *, CASE WHEN ways IS NULL THEN CASE WHEN candidates > 0 THEN 'no_consistent_assignment' ELSE 'no_candidate' END WHEN length < {floor} THEN CASE WHEN x <= length THEN NULL ELSE 'below_hard_floor' END WHEN length / n > {sections.MOST_OF_DOCUMENT} THEN 'above_max_ratio' WHEN alpha < {sections.LEAST_ALPHA} THEN 'below_alpha_ratio' END AS reason,
  array_to_string(list_filter([CASE WHEN ways > 1 THEN 'single_or_no_tiebreak' END, CASE WHEN rung IS NULL OR rung >= CASE item {proper} END THEN 'heading_boundaries' END, CASE WHEN length < CASE item {good} END THEN 'length_gte_high_floor' END, CASE WHEN spot <= last THEN 'after_last_toc_cluster' END], lambda s: s IS NOT NULL), ',') AS low FROM measured),
graded AS (SELECT *, CASE WHEN ways IS NOT NULL AND length < {floor} AND x <= length THEN 'incorporated_by_reference' WHEN reason IS NOT NULL THEN 'failed' WHEN low = '' THEN 'high' ELSE 'low' END AS confidence FROM judged)"""


@query(f"WITH {_known()} SELECT filing, item, confidence, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", CAST(length AS INTEGER) AS length, end_item, rung AS end_rung, reason, CASE WHEN confidence = 'low' THEN low ELSE '' END AS low_reasons, coalesce(ways > 1, false) AS tie FROM graded")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the built filings as they are found in the text; the SQL knows them from the lengths of the parts."""
    return sections.extracted_sections(filings(spark, sf_dir), "filing", "text")


@query(f"WITH {_known()}, c AS (SELECT filing, min(n) AS n, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'incorporated_by_reference') AS referred FROM graded GROUP BY filing), m AS (SELECT filing, n, CASE WHEN high = 3 THEN 'sections' WHEN referred > 0 AND high + referred = 3 THEN 'sections_partial' ELSE 'full_fallback' END AS method FROM c) SELECT filing, method, method <> 'full_fallback' OR n >= {sections.LEAST_DOCUMENT} AS usable FROM m")
def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = filings(spark, sf_dir)
    return sections.extraction_method(sections.extracted_sections(built, "filing", "text"), built, "filing", "text")
