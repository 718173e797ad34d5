"""Queries of disclosure over labelled documents, and of admissible repeats over companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.operators import auditing, disclosure, evaluation
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MET = "met AS (SELECT source, lang, quality, toxic FROM documents JOIN labels USING (doc_id))"
_COUNTS = f"""{_MET},
counts AS (SELECT 'quality of ' || source AS family, CAST(quality AS VARCHAR) AS cell, count(*) AS n FROM met WHERE length(source) % 2 = 1 GROUP BY source, quality UNION ALL SELECT 'toxic of ' || source, CAST(toxic AS VARCHAR), count(*) FROM met WHERE length(source) % 2 = 1 GROUP BY source, toxic
  UNION ALL SELECT 'quality in ' || lang, CAST(quality AS VARCHAR), count(*) FROM met WHERE length(source) % 2 = 0 GROUP BY lang, quality UNION ALL SELECT 'languages of ' || source, lang, count(*) FROM met WHERE length(source) % 2 = 1 GROUP BY source, lang),
members AS (SELECT DISTINCT 'quality of ' || source AS family, 'source ' || source AS total FROM met WHERE length(source) % 2 = 1 UNION SELECT 'toxic of ' || source, 'source ' || source FROM met WHERE length(source) % 2 = 1 UNION SELECT 'quality in ' || lang, 'language ' || lang FROM met WHERE length(source) % 2 = 0
  UNION SELECT 'languages of ' || source, 'source ' || source FROM met WHERE length(source) % 2 = 1),
reach AS (SELECT DISTINCT family, family AS other FROM members UNION SELECT r.family, b.family FROM reach r JOIN members a ON a.family = r.other JOIN members b ON b.total = a.total),
labels_ AS (SELECT family, min(other) AS component FROM reach GROUP BY family),
small AS (SELECT component, min(n) < 5 AS hidden FROM counts JOIN labels_ USING (family) GROUP BY component)"""


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    met = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    odd, even = met.where(F.length("source") % 2 == 1), met.where(F.length("source") % 2 == 0)
    parts = [(odd, "quality of ", "source", "quality"), (odd, "toxic of ", "source", "toxic"), (even, "quality in ", "lang", "quality"), (odd, "languages of ", "source", "lang")]
    counts, members = None, None
    for rows, name, by, cell in parts:
        c = rows.groupBy(F.concat(F.lit(name), by).alias("family"), F.col(cell).cast("string").alias("cell")).agg(F.count("*").alias("n"))
        m = rows.select(F.concat(F.lit(name), by).alias("family"), F.concat(F.lit("source " if by == "source" else "language "), by).alias("total")).distinct()
        counts, members = (c, m) if counts is None else (counts.unionByName(c), members.unionByName(m))
    return counts, members


@query(f"WITH RECURSIVE {_COUNTS} SELECT family, cell, n, CASE WHEN NOT hidden THEN n END AS shown, CASE WHEN n < 5 THEN 'suppressed_lt_5' WHEN hidden THEN 'withheld_secondary_suppression' END AS mark, component FROM counts JOIN labels_ USING (family) JOIN small USING (component)")
def linked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of counts by source, and by language over other sources; the links are found over the totals that they share."""
    return disclosure.disclosed(*_counts(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {_COUNTS}, sums AS (SELECT family, sum(n) AS n FROM counts GROUP BY family), t AS (SELECT total, CAST(max(n) AS BIGINT) AS n, bool_or(hidden) AS hidden FROM members JOIN labels_ USING (family) JOIN small USING (component) JOIN sums USING (family) GROUP BY total) SELECT total, n, CASE WHEN NOT hidden THEN n END AS shown, CASE WHEN n < 5 THEN 'suppressed_lt_5' WHEN hidden THEN 'withheld_secondary_suppression' END AS mark FROM t")
def linked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.disclosed(*_counts(spark, sf_dir))[1]


_SECTION = "CASE hash_ % 7 WHEN 0 THEN 'screen' WHEN 1 THEN 'fundamentals' WHEN 2 THEN 'valuation' WHEN 3 THEN 'committee_support' WHEN 4 THEN 'status_transitions' WHEN 5 THEN 'direct_star' ELSE 'persona' END"
_PARTS = f"""met AS (SELECT source, lang, quality, toxic, length(source) + length(lang) + ascii(source) + ascii(substr(lang, 2)) AS hash_ FROM documents JOIN labels USING (doc_id)),
rows AS (SELECT *, {_SECTION} AS section, CASE quality WHEN 1 THEN 'candidate' ELSE 'baseline' END AS run, source AS view_, lang AS cohort FROM met),
cells AS (SELECT section, run, view_, cohort, 'toxic' AS item, CAST(toxic AS VARCHAR) AS cell, count(*) AS n, section = 'screen' AND run = 'baseline' AS open_ FROM rows GROUP BY ALL),
shares AS (SELECT section, run, view_, cohort, 'share' AS item, count(*) FILTER (WHERE toxic = 1) AS numerator, count(*) AS denominator FROM rows GROUP BY ALL),
assoc AS (SELECT section, run, view_, cohort, 'rho' AS item, count(*) FILTER (WHERE toxic = 0) AS denominator, count(*) AS cohort_n FROM rows GROUP BY ALL),
grp AS (SELECT *, CASE section WHEN 'status_transitions' THEN 'committee_support' WHEN 'valuation' THEN 'valuation/' || cohort ELSE section END AS g FROM (SELECT DISTINCT section, cohort FROM rows)),
small AS (SELECT g, bool_or(s) AS hidden FROM (SELECT section, cohort, NOT open_ AND n < 5 AS s FROM cells
  UNION ALL SELECT section, cohort, (section IN ('fundamentals', 'valuation', 'committee_support') AND (numerator < 5 OR denominator < 5)) OR (section = 'committee_support' AND denominator - numerator < 5) FROM shares
  UNION ALL SELECT section, cohort, section IN ('direct_star', 'persona') AND (denominator < 5 OR cohort_n - denominator < 5) FROM assoc) JOIN grp USING (section, cohort) GROUP BY g)"""
_M = "CASE WHEN {n} < 5 THEN 'suppressed_lt_5' WHEN hidden THEN 'withheld_secondary_suppression' END"


@query(f"""WITH {_PARTS}
SELECT section, run, view_ AS view, cohort, item, cell, coalesce(CASE WHEN NOT open_ THEN {_M.format(n='n')} END, CAST(n AS VARCHAR)) AS numerator, CAST(NULL AS VARCHAR) AS denominator, CAST(NULL AS DOUBLE) AS value FROM cells JOIN grp USING (section, cohort) JOIN small USING (g)
UNION ALL SELECT section, run, view_, cohort, item, NULL, coalesce(CASE WHEN hidden THEN {_M.format(n='numerator')} WHEN denominator < 5 OR numerator < 5 OR denominator - numerator < 5 THEN 'suppressed_lt_5' END, CAST(numerator AS VARCHAR)),
  coalesce(CASE WHEN hidden THEN {_M.format(n='denominator')} WHEN denominator < 5 THEN 'suppressed_lt_5' END, CAST(denominator AS VARCHAR)), CASE WHEN NOT (hidden OR denominator < 5 OR numerator < 5 OR denominator - numerator < 5) THEN CAST(numerator AS DOUBLE) / denominator END FROM shares JOIN grp USING (section, cohort) JOIN small USING (g)
UNION ALL SELECT section, run, view_, cohort, item, NULL, NULL, coalesce(CASE WHEN hidden OR denominator < 5 OR cohort_n - denominator < 5 THEN CASE WHEN denominator < 5 THEN 'suppressed_lt_5' ELSE 'withheld_secondary_suppression' END END, CAST(denominator AS VARCHAR)), CASE WHEN NOT (hidden OR denominator < 5 OR cohort_n - denominator < 5) THEN CAST(denominator AS DOUBLE) / cohort_n END FROM assoc JOIN grp USING (section, cohort) JOIN small USING (g)""")
def public_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as companies: a section, a run, a view and a cohort follow from source, language and label."""
    met = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    place = (F.length("source") + F.length("lang") + F.ascii("source") + F.ascii(F.substring("lang", 2, 1))) % 7
    names = ("screen", "fundamentals", "valuation", "committee_support", "status_transitions", "direct_star", "persona")
    section = F.element_at(F.array(*map(F.lit, names)), place + 1)
    by = ["section", "run", "view", "cohort"]
    rows = met.select(section.alias("section"), F.when(F.col("quality") == 1, "candidate").otherwise("baseline").alias("run"), F.col("source").alias("view"), F.col("lang").alias("cohort"), "toxic")
    cells = rows.groupBy(*by, F.col("toxic").cast("string").alias("cell")).agg(F.count("*").alias("n")).select(*by, F.lit("toxic").alias("item"), "cell", "n", ((F.col("section") == "screen") & (F.col("run") == "baseline")).alias("open"))
    shares = rows.groupBy(*by).agg(F.count_if(F.col("toxic") == 1).alias("numerator"), F.count("*").alias("denominator")).select(*by, F.lit("share").alias("item"), "numerator", "denominator", (F.col("numerator") / F.col("denominator")).alias("value"))
    associations = rows.groupBy(*by).agg(F.count_if(F.col("toxic") == 0).alias("denominator"), F.count("*").alias("cohort_n")).select(*by, F.lit("rho").alias("item"), "denominator", "cohort_n", (F.col("denominator") / F.col("cohort_n")).alias("value"))
    return disclosure.public_sections(cells, shares, associations)


# admissible repeats

_REPEATS = """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer)
SELECT 'same' AS repeat, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS detail
UNION ALL SELECT 'copied', CASE WHEN count(*) FILTER (WHERE k % 9 = 4) > 0 THEN 'replicate_contains_cache_reused_verdicts' END, NULL FROM c
UNION ALL SELECT 'others', CASE WHEN count(*) FILTER (WHERE nation = 3) > 0 THEN 'replicate_cohort_does_not_equal_stored_candidate_cohort' END, NULL FROM c
UNION ALL SELECT 'inputs', 'committee_bundle_equivalence_failed', '{"cross_snapshot_bundle_mismatch":' || count(*) FILTER (WHERE nation = 5) || ',"replicate_cache_key_mismatch":' || count(*) FILTER (WHERE nation = 5) || '}' FROM c
"""


@query(_REPEATS)
def repeat_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four repeats of a run whose companies are the customers: the same, with copied verdicts, without a nation, with other inputs of one."""
    k = F.col("c_custkey")
    scores = {"business": k % 101, "moat": k % 97, "strength": k % 89, "management": k % 83, "valuation": k % 79, "risk": k % 73}
    c = table(spark, sf_dir, "customer").select(k.alias("ticker"), "c_nationkey", F.sha2("c_name", 256).alias("cache_key"), *[v.cast("double").alias(n) for n, v in scores.items()], F.lit("low").alias("severity"))
    score = evaluation.overall_score({n: F.col(n) for n in evaluation.WEIGHTS})
    status = F.when(F.col("overall_score") >= 70, "Investigate").when(F.col("overall_score") >= 50, "Watch").otherwise("Reject")
    stored = c.withColumn("overall_score", score).withColumn("status", status).withColumn("quality_run_id", F.lit("q")).withColumn("valuation_run_id", F.lit("v")).withColumn("reused_from_run_id", F.lit(None).cast("string"))
    bundles = c.select("ticker", F.col("cache_key").alias("bundle"))
    others = c.select("ticker", F.when(F.col("c_nationkey") == 5, F.sha2(F.col("cache_key"), 256)).otherwise(F.col("cache_key")).alias("bundle"))
    runs = spark.createDataFrame([("r", "committee", "complete")], "run_id string, stage_reached string, status string")
    cases = {
        "same": (stored, bundles), "copied": (stored.withColumn("reused_from_run_id", F.when(F.col("ticker") % 9 == 4, "old")), bundles),
        "others": (stored.where("c_nationkey <> 3"), bundles), "inputs": (stored, others),
    }
    out = None
    for name, (replicate, theirs) in cases.items():
        row = auditing.admissibility(stored, replicate, runs, bundles, theirs, replicate_run="r", frozen_runs=["s"], quality_run="q", valuation_run="v", digests=("d", "d", "d"), aliased=False, provenance="same").select(F.lit(name).alias("repeat"), "reason", "detail")
        out = row if out is None else out.unionByName(row)
    return out
