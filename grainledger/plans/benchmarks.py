"""Queries of a benchmark's exports, figures as text, costs and stale analyses over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.operators import benchmarking, committee, evidence, screen, valuation
from grainledger.plans.base import panel
from grainledger.plans.evidencing import _ANALYSES, _analyses, _claims
from grainledger.plans.screening import _QUALITY, _SCORES, _scores
from grainledger.plans.valuing import _VALUES
from grainledger.session import parts_of
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH g AS (SELECT o_orderkey AS k, ['A', 'b', 'C', 'd', 'F', 'E'][o_orderkey % 6 + 1] || ['', '+', '-', '++'][o_custkey % 4 + 1] AS grade, CASE o_custkey % 5 WHEN 0 THEN CAST(o_orderkey % 8 AS VARCHAR) WHEN 1 THEN (o_orderkey % 7) || ' stars' WHEN 2 THEN repeat('★', (o_orderkey % 7)::INTEGER) || '☆' WHEN 3 THEN 'none' ELSE (o_orderkey % 6) || '.0' END AS stars FROM orders)
SELECT k, CASE WHEN upper(left(grade, 1)) = 'E' OR length(grade) > 2 THEN NULL ELSE CASE upper(left(grade, 1)) WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END::DOUBLE + CASE right(grade, 1) WHEN '+' THEN 0.33 WHEN '-' THEN -0.33 ELSE 0.0 END::DOUBLE END AS grade,
  CASE WHEN stars LIKE '%★%' OR stars = '☆' THEN CASE WHEN length(stars) - 1 BETWEEN 1 AND 5 THEN length(stars) - 1 END WHEN left(stars, 1) BETWEEN '1' AND '5' THEN CAST(left(stars, 1) AS INTEGER) END::INTEGER AS stars FROM g""")
def grades_and_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades and ratings as they are written in exports, odd ones among them."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    grade = F.concat(pick(("A", "b", "C", "d", "F", "E"), k % 6), pick(("", "+", "-", "++"), c % 4))
    stars = F.when(c % 5 == 0, (k % 8).cast("string")).when(c % 5 == 1, F.concat((k % 7).cast("string"), F.lit(" stars"))).when(c % 5 == 2, F.concat(F.repeat(F.lit("★"), (k % 7).cast("int")), F.lit("☆"))).when(c % 5 == 3, "none").otherwise(F.concat((k % 6).cast("string"), F.lit(".0")))
    return o.select(k.alias("k"), benchmarking.grade_ordinal(grade).alias("grade"), benchmarking.star_rating(stars).alias("stars"))


@query("""SELECT s_suppkey AS ticker, s_name AS company_name, s_acctbal AS fair_value, s_acctbal * 0.9 AS last_price, s_acctbal * 0.7 AS five_star_price, s_acctbal * 1.4 AS one_star_price, CAST(s_nationkey AS BIGINT) AS ebitda, CAST(s_nationkey + 1 AS BIGINT) AS ebit,
  CASE WHEN s_acctbal <> 0 THEN round(s_acctbal * 0.9 / s_acctbal, 6) END AS price_fair_value_calc, CASE WHEN s_acctbal <> 0 THEN round((1 - s_acctbal * 0.7 / s_acctbal) * 100, 2) END AS required_margin_of_safety_pct, CASE WHEN s_acctbal <> 0 THEN round(s_acctbal * 1.4 / (s_acctbal * 0.7), 4) END AS band_width_x FROM supplier""")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under an export's headings, mapped to fields, with the bands of their prices."""
    s, a = table(spark, sf_dir, "supplier"), F.col("s_acctbal")
    export = s.select(F.col("s_suppkey").alias("Ticker"), F.col("s_name").alias("Name  (Full)"), a.alias("Fair Value (USD)"), (a * 0.9).alias("Last Price"), (a * 0.7).alias("5-Star Price"), (a * 1.4).alias("1-Star Price"), F.col("s_nationkey").cast("long").alias("EBITDA (Mil)"), (F.col("s_nationkey") + 1).cast("long").alias("EBIT (Mil)"), F.lit(1).alias("Other"), F.lit("second").alias("Name"))
    return benchmarking.bands(benchmarking.mapped(export))


@query("""WITH r AS (SELECT c_custkey AS ticker, c_mktsegment AS stratum, CASE c_custkey % 2 WHEN 0 THEN '2024-01-31' ELSE '2024-02-29' END AS snapshot_date, c_acctbal AS price FROM customer)
SELECT ticker, stratum, snapshot_date, CASE WHEN stratum = 'BUILDING' THEN price + 1 ELSE price END AS price FROM r WHERE ticker % 3 <> 0 OR stratum = 'BUILDING'""")
def benchmark_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records of all strata, and a new export of one."""
    c = table(spark, sf_dir, "customer")
    r = c.select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("stratum"), F.when(F.col("c_custkey") % 2 == 0, "2024-01-31").otherwise("2024-02-29").alias("snapshot_date"), F.col("c_acctbal").alias("price"))
    return benchmarking.merged(r.where("ticker % 3 <> 0"), r.where("stratum = 'BUILDING'").withColumn("price", F.col("price") + 1))


@query(_SCORES + _QUALITY + """, lines AS (SELECT ticker, string_agg(CASE WHEN status IN ('unavailable', 'not_applicable') THEN metric || ': ' || status WHEN value IS NULL THEN metric || ': ' || status || ' (no comparable ratio computed)'
  ELSE metric || ': ' || printf('%.4f', value + 0.0) || ' (' || status || CASE WHEN percentile IS NOT NULL THEN ', ' || printf('%.0f', percentile) || 'th percentile in ' || coalesce(sector, '(no sector)') ELSE '' END || ')' END, chr(10) ORDER BY metric) AS l FROM scores GROUP BY ticker)
SELECT ticker, l || chr(10) || 'composite_score: ' || printf('%.1f', CASE WHEN assessed > 0 THEN 100.0 * passed / assessed ELSE 0.0 END) || ' (' || passed || '/' || assessed || ' assessable metrics passed)' AS block FROM lines JOIN quality USING (ticker)""")
def quant_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's metrics as the text that a reader is given."""
    long = _scores(spark, sf_dir).withColumn("value", F.round("value", 6)).withColumn("percentile", F.round("percentile", 6))
    return benchmarking.quant_block(long, screen.quality(long))


_CASH = "'$' || format('{{:,.2f}}', {v})"


@query(_VALUES + f""", x AS (SELECT ticker, scenario, round(value, 2) AS v, CASE WHEN ticker % 13 <> 0 THEN c_acctbal * 300 + 1 END AS price FROM values_ JOIN customer ON c_custkey = ticker),
l AS (SELECT ticker, max(price) AS price, string_agg('DCF ' || scenario || ': ' || CASE WHEN v IS NULL THEN 'unavailable' WHEN v <= 0 THEN {_CASH.format(v='v')} || ' — not investable on this basis' ELSE {_CASH.format(v='v')} || ' (margin of safety vs. current price: ' || coalesce(printf('%+.1f', (v / price - 1) * 100) || '%', 'n/a') || ')' END, chr(10) ORDER BY CASE scenario WHEN 'bear' THEN 1 WHEN 'base' THEN 2 ELSE 3 END) AS lines FROM x GROUP BY ticker)
SELECT ticker, coalesce('Current price: ' || {_CASH.format(v='price')} || chr(10), '') || lines AS block FROM l""")
def valuation_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal") * 300 + 1).alias("price"))
    v = valuation.scenario_values(panel(spark, sf_dir)).select("ticker", "scenario", F.round("value", 2).alias("value"))
    return benchmarking.valuation_block(v.join(c, "ticker"))


@query("SELECT conv_id, CASE conv_id % 2 WHEN 0 THEN 'large' ELSE 'small' END AS model, CAST(sum(length(text)) AS BIGINT) AS input_tokens, round((sum(length(text)) * CASE conv_id % 2 WHEN 0 THEN 3.0 ELSE 0.8 END + 8000 * CASE conv_id % 2 WHEN 0 THEN 15.0 ELSE 4.0 END) / 1e6 * CASE WHEN conv_id % 3 = 0 THEN 0.5 ELSE 1.0 END, 8) AS projected FROM conversations GROUP BY conv_id")
def projected_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation would cost as a request, before it is sent: its characters as tokens, and an assumed reply."""
    prices = spark.createDataFrame([("large", 3.0, 15.0), ("small", 0.8, 4.0)], "model string, input_price double, output_price double")
    usage = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("input_tokens")).select("conv_id", F.when(F.col("conv_id") % 2 == 0, "large").otherwise("small").alias("model"), "input_tokens", (F.col("conv_id") % 3 == 0).alias("batch"))
    return committee.projected_cost(usage, prices).select("conv_id", "model", "input_tokens", F.round("projected", 8).alias("projected"))


@query(f"WITH {_ANALYSES}, shown AS (SELECT a.run_id, a.ticker, a.analysis_type, claim_id FROM analyses a JOIN claims c ON c.run_id = coalesce(a.reused_from_run_id, a.run_id) AND c.ticker = a.ticker AND c.analysis_type = a.analysis_type WHERE is_current) SELECT run_id, ticker, analysis_type, count(*) FILTER (WHERE claim_id % 11 IN (3, 4)) AS degraded, count(*) AS checked, bool_or(claim_id % 11 IN (3, 4)) AS stale FROM shown GROUP BY ALL")
def stale_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current analyses with the last results of checking their citations, one a claim; earlier results don't count any more."""
    claims = _claims(spark, sf_dir)
    k = F.col("claim_id")
    result = F.when(k % 11 == 3, "fuzzy").when(k % 11 == 4, "unresolved").otherwise("exact")
    event = lambda at, r: claims.select("claim_id", k.alias("citation_id"), F.lit(at).alias("checked_at"), r.alias("result"))
    events = event(2, result).unionByName(event(1, F.when(k % 2 == 0, "unresolved").otherwise("exact")))
    return evidence.stale_analyses(_analyses(spark, sf_dir).where("is_current"), claims, events, parts_of(table(spark, sf_dir, "lineitem")))


_VERDICTS = """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 0.03 END AS cap, c_custkey % 101 AS business, c_custkey % 97 AS moat, c_custkey % 89 AS management, c_custkey % 83 AS risk, c_custkey % 79 AS valuation, c_custkey % 73 AS strength, CASE c_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity FROM customer),
g AS (SELECT *, CASE WHEN k % 17 = 0 THEN CASE WHEN k % 2 = 0 THEN 'missing: management,moat' ELSE 'missing: moat' END WHEN k % 13 = 0 THEN 'no valuation' END AS lacks FROM c),
r AS (SELECT *, CASE WHEN lacks IS NOT NULL THEN ['api_error', lacks, '0'] WHEN k % 11 = 0 THEN ['cache_hit', NULL, '0'] WHEN k % 23 = 1 THEN ['refused', 'quality', '1'] WHEN k % 37 = 1 THEN ['validation_failed', 'quality: unknown_ref:999', '1'] WHEN k % 19 = 1 THEN ['api_error', 'bear call failed', '1']
  WHEN k % 31 = 1 THEN ['validation_failed', 'bear: no_severity', '2'] WHEN cap IS NOT NULL THEN ['cost_capped', 'valuation', '2'] WHEN k % 29 = 1 THEN ['validation_failed', 'valuation: few_statements', '3'] ELSE ['persisted', NULL, '3'] END AS e FROM g),
s AS (SELECT *, 0.25::DOUBLE * business + 0.20::DOUBLE * moat + 0.15::DOUBLE * strength + 0.10::DOUBLE * management + 0.25::DOUBLE * valuation + 0.05::DOUBLE * (100 - risk) AS score FROM r)
SELECT k AS ticker, e[1] AS outcome, e[2] AS reason, round(0.02 * CAST(e[3] AS INTEGER), 6)::DOUBLE AS cost, CASE WHEN e[1] = 'persisted' THEN round(score, 7) END AS overall_score,
  CASE WHEN e[1] = 'persisted' THEN CASE WHEN score >= 70 AND severity <> 'high' THEN 'Investigate' WHEN score >= 50 THEN 'Watch' ELSE 'Reject' END END AS status FROM s"""


@query(_VERDICTS)
def committee_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies: their analyses, valuations and the readers' replies follow from their keys, each gate being met by some."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    companies = c.select(k.alias("ticker"), F.lit(True).alias("known"), F.when(k % 7 == 0, 0.03).alias("cap"))
    kinds = F.when(k % 34 == 0, F.array(F.lit("business_quality"), F.lit("risk"))).when(k % 17 == 0, F.array(*[F.lit(x) for x in committee.KINDS if x != "moat"])).otherwise(F.array(*map(F.lit, committee.KINDS)))
    analyses = c.select(k.alias("ticker"), F.explode(kinds).alias("analysis_type"))
    line = lambda label, n: F.concat(F.lit(f"{label}: "), (k % n).cast("string"), F.lit("\n"))
    severity = F.when(F.col("c_nationkey") % 3 == 0, "high").when(F.col("c_nationkey") % 3 == 1, "LOW").otherwise("medium")
    said = lambda ref: F.concat(F.lit("## STATEMENTS\n"), *[F.concat(F.lit(f"STATEMENT: line {i} [refs: "), ref, F.lit("]\n")) for i in range(4)])
    head = F.lit("## VERDICT\nas it is\n## SCORES\n")
    own = k.cast("string")
    few = F.lit("## STATEMENTS\nSTATEMENT: only one\n")
    raw = {
        "quality": F.concat(head, line("BUSINESS_QUALITY", 101), line("COMPETITIVE_MOAT", 97), line("MANAGEMENT", 89), said(F.when(k % 37 == 1, "999").otherwise(own))),
        "bear": F.concat(head, line("RISK", 83), F.when(k % 31 == 1, "").otherwise(F.concat(F.lit("SEVERITY: "), severity, F.lit("\n"))), said(own)),
        "valuation": F.concat(head, line("VALUATION", 79), line("FINANCIAL_STRENGTH", 73), F.when(k % 29 == 1, few).otherwise(said(F.lit("DCF base")))),
    }
    calls = F.array(*[F.struct(F.lit(p).alias("persona"), t.alias("raw"), ((k % 19 == 1) & F.lit(p == "bear")).alias("failed"), F.when((k % 23 == 1) & F.lit(p == "quality"), "refusal").otherwise("end_turn").alias("stop_reason"), F.lit(0.02).alias("cost")) for p, t in raw.items()])
    replies = committee.persona_replies(c.select(k.alias("ticker"), F.inline(calls)), c.select(k.alias("ticker"), F.array(own).alias("refs")), ["ticker"])
    got = committee.verdicts(companies, analyses, c.where(k % 13 != 0).select(k.alias("ticker")), c.where(k % 11 == 0).select(k.alias("ticker")), replies)
    return got.withColumn("cost", F.round("cost", 6)).withColumn("overall_score", F.round("overall_score", 7))
