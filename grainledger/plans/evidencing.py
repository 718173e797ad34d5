"""Queries of evidence, reuse, keys and checks of records.

An order stands for an analysis: run, company (customer), kind (priority). An order line is a claim of it that cites a filing
(part). A kind's later orders were copied from its first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions import keys
from grainledger.operators import evaluation, evidence, upsert, valuation
from grainledger.plans.base import PANEL_SQL, panel
from grainledger.plans.valuing import _VALUES
from grainledger.session import dealt, parts_of
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ANALYSES = """
analyses AS (
  SELECT o_orderkey AS run_id, o_custkey AS ticker, o_orderpriority AS analysis_type, o_orderdate AS created_at, o_orderstatus AS cache_key,
         CASE WHEN row_number() OVER w > 1 THEN first_value(o_orderkey) OVER w END AS reused_from_run_id,
         lead(o_orderkey) OVER w IS NULL AS is_current
  FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)),
claims AS (
  SELECT l_orderkey * 8 + l_linenumber AS claim_id, l_orderkey AS run_id, o_custkey AS ticker, o_orderpriority AS analysis_type, l_linenumber AS claim_order, l_partkey AS accession
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("ticker", "analysis_type").orderBy("created_at", "run_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("analysis_type"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("cache_key"))
    return o.select("*", F.when(F.row_number().over(w) > 1, F.first("run_id").over(w)).alias("reused_from_run_id"), F.lead("run_id").over(w).isNull().alias("is_current"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("analysis_type"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), F.col("l_linenumber").alias("claim_order"), F.col("l_partkey").alias("accession"))
    parts = parts_of(lines)
    return dealt(lines, parts, "run_id").join(dealt(o, parts, "run_id"), "run_id")


# evidence


@query(f"WITH {_ANALYSES} SELECT a.run_id, a.ticker, a.analysis_type, claim_id, claim_order FROM analyses a JOIN claims c ON c.run_id = coalesce(a.reused_from_run_id, a.run_id) AND c.ticker = a.ticker AND c.analysis_type = a.analysis_type WHERE is_current")
def shown_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.shown_claims(_analyses(spark, sf_dir).where("is_current"), _claims(spark, sf_dir), parts_of(table(spark, sf_dir, "lineitem"))).select("run_id", "ticker", "analysis_type", "claim_id", "claim_order")


@query(f"WITH {_ANALYSES} SELECT DISTINCT q.accession, c.claim_id, c.run_id, c.ticker, c.analysis_type, c.claim_order, a.is_current FROM claims c JOIN claims q ON q.claim_id = c.claim_id JOIN analyses a ON a.run_id = c.run_id AND a.ticker = c.ticker AND a.analysis_type = c.analysis_type")
def filing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    return evidence.filing_evidence(c.select("claim_id", "accession"), c.drop("accession"), _analyses(spark, sf_dir), parts_of(table(spark, sf_dir, "lineitem")))


@query(f"WITH {_ANALYSES} SELECT DISTINCT a.ticker, c.accession, p_name AS name FROM analyses a JOIN claims c ON c.run_id = coalesce(a.reused_from_run_id, a.run_id) AND c.ticker = a.ticker AND c.analysis_type = a.analysis_type JOIN part ON p_partkey = c.accession WHERE is_current")
def source_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    shown = evidence.shown_claims(_analyses(spark, sf_dir).where("is_current"), c.drop("accession"), parts_of(table(spark, sf_dir, "lineitem")))
    return evidence.source_filings(shown, c, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("accession"), F.col("p_name").alias("name")))


_CITED = """
cited AS (
  SELECT doc_id AS citation_id, doc_id AS accession, CASE WHEN lang = 'en' THEN sha256(text) ELSE sha256(substr(text, 1, 400)) END AS sha, 10 AS s, 60 AS e, substr(lower(text), 11, 50) AS quote, source IS NOT NULL AS is_current FROM documents
  UNION ALL SELECT -item_id - 1, -item_id - 1, sha256(text), 0, 20, substr(text, 1, 20), TRUE FROM benchmark)"""


@query(f"WITH {_CITED}, met AS (SELECT citation_id, is_current, CASE WHEN d.doc_id IS NULL THEN 'document missing' WHEN sha256(d.text) IS DISTINCT FROM sha THEN 'digest changed' WHEN d.text IS NULL THEN 'text missing' WHEN e > length(d.text) THEN 'offsets out of range' WHEN substr(d.text, s + 1, e - s) IS DISTINCT FROM quote THEN 'text differs' ELSE '' END AS detail FROM cited LEFT JOIN documents d ON d.doc_id = accession) SELECT citation_id, CASE WHEN NOT is_current THEN 'historical' WHEN detail = '' THEN 'current' WHEN detail = 'digest changed' THEN 'stale source' ELSE 'anchor unresolved' END AS state, detail FROM met")
def citation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cites itself, in small letters and where not in English by the digest of its beginning; each benchmark item a document that isn't there."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = lambda df, id_, sha, s, e, quote, now: df.select(id_.alias("citation_id"), id_.alias("accession"), F.lit("full").alias("section_id"), F.lit(1).alias("norm_version"), sha.alias("doc_sha256"), F.lit(s).alias("start_char"), F.lit(e).alias("end_char"), quote.alias("quote"), now.alias("is_current"))
    sha = F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise(F.sha2(F.substring("text", 1, 400), 256))
    cited = one(d, F.col("doc_id"), sha, 10, 60, F.substring(F.lower("text"), 11, 50), F.col("source").isNotNull())
    cited = cited.union(one(b, -F.col("item_id") - 1, F.sha2("text", 256), 0, 20, F.substring("text", 1, 20), F.lit(True)))
    documents = d.select(F.col("doc_id").alias("accession"), F.lit("full").alias("section_id"), F.lit(1).alias("norm_version"), F.sha2("text", 256).alias("doc_sha256"), "text")
    return evidence.citation_states(cited, documents)


_LATEST = lambda status: f"(SELECT o_custkey AS ticker, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1)"


@query(f"WITH v AS (SELECT o_custkey AS ticker, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS v, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS q FROM orders GROUP BY 1) SELECT v.ticker, v IS NOT NULL AS recorded, CASE WHEN v IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.run_id IS DISTINCT FROM v AND a.run_id IS NOT NULL THEN 'valuation' END, CASE WHEN b.run_id IS DISTINCT FROM q AND b.run_id IS NOT NULL THEN 'quality' END) END AS newer FROM v LEFT JOIN {_LATEST('F')} a ON a.ticker = v.ticker LEFT JOIN {_LATEST('O')} b ON b.ticker = v.ticker")
def newer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "ticker")
    is_ = lambda s: F.col("o_orderstatus") == s
    verdicts = o.groupBy("ticker").agg(F.min(F.when(is_("F"), F.col("o_orderkey"))).alias("valuation_run_id"), F.max(F.when(is_("O"), F.col("o_orderkey"))).alias("quality_run_id"))
    last = lambda s: o.where(is_(s)).groupBy("ticker").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"))
    return evidence.newer_inputs(verdicts, valuation=last("F"), quality=last("O")).withColumn("newer", F.array_join("newer", ","))


_COPIED = f"""
WITH {_ANALYSES},
source AS (SELECT ticker, cache_key, arg_min(run_id, (created_at, run_id)) AS source_run_id FROM analyses WHERE reused_from_run_id IS NULL GROUP BY 1, 2),
hits AS (SELECT -c_custkey AS run, c_custkey AS ticker, source_run_id FROM customer JOIN source ON source.ticker = c_custkey AND cache_key = 'F')
SELECT run_id, a.ticker, analysis_type, reused_from_run_id, CASE WHEN h.run IS NULL THEN is_current ELSE FALSE END AS is_current FROM analyses a LEFT JOIN hits h ON h.ticker = a.ticker
UNION ALL SELECT h.run, a.ticker, analysis_type, source_run_id, TRUE FROM hits h JOIN analyses a ON a.ticker = h.ticker AND a.run_id = source_run_id"""


@query(_COPIED)
def copied_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer asks anew for what the oldest of its finished orders answers."""
    asked = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("run_id"), F.col("c_custkey").alias("ticker"), F.lit("F").alias("cache_key"), F.lit("2100-01-01").cast("timestamp").alias("created_at"))
    analyses = _analyses(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return evidence.copied_forward(analyses, asked).select("run_id", "ticker", "analysis_type", "reused_from_run_id", "is_current")


@query("SELECT o_orderkey AS custom_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "custom_id")
    return evidence.pending(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("custom_id")), done.where("l_returnflag = 'R'"), done.where("l_linestatus = 'F'"))


@query("SELECT l_partkey AS part, CAST(year(l_shipdate) AS INTEGER) AS period, count(*) AS versions, count(DISTINCT l_quantity) AS distinct_values, arg_min(l_quantity, (l_shipdate, l_orderkey * 8 + l_linenumber, l_quantity)) AS first_value, arg_max(l_quantity, (l_shipdate, l_orderkey * 8 + l_linenumber, l_quantity)) AS last_value, count(DISTINCT l_quantity) > 1 AS restated FROM lineitem GROUP BY 1, 2")
def fact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("period"), "l_quantity", "l_shipdate", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("accession"))
    return evidence.fact_versions(facts, ["part", "period"], "l_quantity", "l_shipdate", "accession").drop("first_accession", "last_accession")


_FILINGS = """
filings AS (SELECT o_custkey AS ticker, o_orderkey AS accession, CASE o_orderstatus WHEN 'O' THEN '10-K/A' ELSE '10-K' END AS form_type, year(o_orderdate) AS period, o_orderdate AS filing_date, o_orderpriority <> '5-LOW' AS cached FROM orders),
ok AS (SELECT DISTINCT l_orderkey AS accession FROM lineitem WHERE l_returnflag = 'A'),
newest AS (SELECT f.*, ok.accession IS NOT NULL AS fine FROM filings f LEFT JOIN ok ON ok.accession = f.accession WHERE cached)"""


@query(f"WITH {_FILINGS}, a AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period DESC, filing_date DESC, accession DESC) = 1), b AS (SELECT * FROM newest WHERE form_type = '10-K' QUALIFY row_number() OVER (PARTITION BY ticker, period ORDER BY filing_date DESC, accession DESC) = 1), r AS (SELECT t.ticker, a.accession AS first_, CASE WHEN a.fine THEN a.accession WHEN a.form_type = '10-K/A' AND b.fine THEN b.accession END AS accession FROM (SELECT DISTINCT ticker FROM filings) t LEFT JOIN a ON a.ticker = t.ticker LEFT JOIN b ON b.ticker = a.ticker AND b.period = a.period) SELECT ticker, accession, CASE WHEN first_ IS NULL THEN 'no filing' WHEN accession IS NULL THEN 'extraction failed' END AS error FROM r")
def usable_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession"), F.when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-K").alias("form_type"),
        F.year("o_orderdate").alias("period"), F.col("o_orderdate").alias("filing_date"), (F.col("o_orderpriority") != "5-LOW").alias("cached"),
    )
    return evidence.usable_filing(filings, table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("accession")))


_SECTIONS = "sections AS (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'item_1' WHEN 1 THEN 'item_7' WHEN 2 THEN 'item_1a' ELSE 'full' END AS section_id, min(turn) AS document_id FROM conversations GROUP BY 1, 2)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(s) for s in ("item_1", "item_7", "item_1a", "full")]), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id", kind.alias("section_id")).agg(F.min("turn").alias("document_id"))


@query(f"WITH {_SECTIONS}, h AS (SELECT conv_id, list(section_id) AS have FROM sections GROUP BY 1) SELECT conv_id, CASE WHEN list_contains(have, 'full') THEN '' ELSE array_to_string(list_filter(['item_1', 'item_1a', 'item_7'], lambda s: NOT list_contains(have, s)), ',') END AS gaps FROM h")
def gap_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _sections(spark, sf_dir).groupBy("conv_id").agg(F.collect_list("section_id").alias("have"))
    return have.select("conv_id", F.array_join(evidence.gap_sections(F.col("have")), ",").alias("gaps"))


_NOTE = "array_to_string(list_transform(list_filter(['item_1', 'item_1a', 'item_7'], lambda s: NOT list_contains(have, s)), lambda s: '- ' || CASE s WHEN 'item_1' THEN 'Item 1: Business' WHEN 'item_1a' THEN 'Item 1A: Risk Factors' ELSE 'Item 7: MD&A' END), chr(10))"
_SAID = "'NOTE: The following section(s) are incorporated by reference in this filing and are not available for citation:' || chr(10) || {note} || chr(10) || 'Use INSUFFICIENT EVIDENCE for any claim that would require them.'"
_ASKED = "'Analyse C' || conv_id || chr(39) || 's 10-K for the period ending ' || CASE WHEN conv_id % 5 = 0 THEN 'unknown' ELSE '2024-12-31' END || ' and produce the four sections (BUSINESS QUALITY, MOAT, MANAGEMENT, RISK) using the format specified in the system prompt.'"


@query(f"WITH {_SECTIONS}, h AS (SELECT conv_id, list(section_id) AS have FROM sections GROUP BY 1) SELECT conv_id, CASE WHEN NOT list_contains(have, 'full') AND {_NOTE} <> '' THEN {_SAID.format(note=_NOTE)} END AS note, {_ASKED} AS request FROM h")
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said behind the documents of each request."""
    have = _sections(spark, sf_dir).groupBy("conv_id").agg(F.collect_list("section_id").alias("have"))
    texts = evidence.request_texts(F.col("have"), F.concat(F.lit("C"), F.col("conv_id").cast("string")), F.when(F.col("conv_id") % 5 != 0, "2024-12-31"))
    return have.select("conv_id", *[c.alias(k) for k, c in texts.items()])


@query(f"WITH {_SECTIONS} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE section_id WHEN 'item_1' THEN 1 WHEN 'item_1a' THEN 2 WHEN 'item_7' THEN 3 ELSE 4 END) - 1 AS INTEGER) AS document_index, section_id, CASE section_id WHEN 'item_1' THEN 'Item 1: Business' WHEN 'item_1a' THEN 'Item 1A: Risk Factors' WHEN 'item_7' THEN 'Item 7: MD&A' ELSE 'Full Filing' END AS title, document_id FROM sections")
def request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.request_documents(_sections(spark, sf_dir), ["conv_id"])


@query("WITH k AS (SELECT conv_id, role, string_agg('[' || turn || '] ' || text, chr(10) ORDER BY turn) AS lines FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) SELECT conv_id, string_agg('## ' || role || chr(10) || lines, chr(10) || chr(10) ORDER BY role) AS block FROM k GROUP BY 1")
def claims_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null").withColumn("ref", F.col("turn").cast("string"))
    return evidence.claims_block(c, ["conv_id"], "role", "turn", "ref", "text")


# merges and checks


@query("WITH e AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS custom_id, event_id, ts FROM events) SELECT * FROM e WHERE custom_id IS NULL UNION ALL (SELECT * FROM e WHERE custom_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1)")
def attempts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events are a later batch than even ones; views have no id of their own."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("custom_id"), "event_id", "ts")
    return upsert.upsert_attempts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "custom_id", "ts", "event_id")


@query(f"WITH {PANEL_SQL}, p AS (SELECT ticker, arg_max(abs(operating_margin), fiscal_year) AS b, arg_max(abs(net_income / nullif(total_debt, 0)), fiscal_year) AS a FROM panel GROUP BY 1) SELECT o.outcome, count(p.ticker) AS n FROM (VALUES ('improved'), ('worsened'), ('unchanged'), ('unavailable')) o(outcome) LEFT JOIN p ON o.outcome = CASE WHEN a IS NULL OR b IS NULL THEN 'unavailable' WHEN a < b THEN 'improved' WHEN a > b THEN 'worsened' ELSE 'unchanged' END GROUP BY 1")
def improvement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.struct(F.abs("operating_margin").alias("b"), F.when(F.col("total_debt") != 0, F.abs(F.col("net_income") / F.col("total_debt"))).alias("a"))
    ranked = lambda f: F.max_by(both[f], F.when(both[f].isNotNull(), F.col("fiscal_year"))).alias(f)
    return evaluation.improvements(panel(spark, sf_dir).groupBy("ticker").agg(ranked("b"), ranked("a")), "b", "a")


_VIEWS = _VALUES + """
, s AS (SELECT v.ticker, scenario, round(value, 2) AS low, CASE WHEN v.ticker % 7 = 0 AND scenario = 'bull' THEN 2.0 ELSE 1.0 END * c_acctbal * 100 AS price FROM values_ v JOIN customer ON c_custkey = v.ticker),
w AS (SELECT ticker, max(low) FILTER (WHERE scenario = 'bear') AS bear, max(low) FILTER (WHERE scenario = 'base') AS base, max(low) FILTER (WHERE scenario = 'bull') AS bull, count(*) AS n, bool_and(low IS NOT DISTINCT FROM low) AS tight, min(price) AS p1, max(price) AS p2 FROM s GROUP BY 1),
r AS (SELECT c_custkey AS ticker, c_acctbal * 500 AS other, coalesce(n, 0) AS n, bear, base, bull, p1, p2, coalesce(p1 <> p2, FALSE) AS clash FROM customer LEFT JOIN w ON w.ticker = c_custkey),
v AS (SELECT *, 'as_run' AS view_, CASE WHEN NOT clash THEN p1 END AS price FROM r UNION ALL SELECT *, 'price_normalised', other FROM r),
z AS (SELECT *, CASE WHEN clash AND view_ = 'as_run' THEN 'prices differ' WHEN n = 0 THEN 'no scenarios' WHEN n <> 3 THEN 'not three scenarios' WHEN bear IS NULL OR base IS NULL OR bull IS NULL THEN 'unknown value' WHEN bear <= 0 OR base <= 0 OR bull <= 0 THEN 'value not positive' WHEN bear >= base OR base >= bull THEN 'scenarios out of order' WHEN price IS NULL OR price <= 0 THEN 'no price' END AS reason FROM v)
SELECT ticker, view_ AS view, CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN price <= bear THEN 'cheap' WHEN price >= bull THEN 'expensive' ELSE 'fair' END AS value_class, reason FROM z"""


@query(_VIEWS)
def price_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances stand for prices; of each seventh company the scenarios were run at different ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), "c_acctbal")
    v = valuation.scenario_values(panel(spark, sf_dir)).join(c, "ticker")
    at = F.when((F.col("ticker") % 7 == 0) & (F.col("scenario") == "bull"), 2.0).otherwise(1.0) * F.col("c_acctbal") * 100
    s = v.select("ticker", "scenario", F.round("value", 2).alias("low"), F.round("value", 2).alias("high"), at.alias("current_price"))
    return evaluation.price_views(s, c.select("ticker", (F.col("c_acctbal") * 500).alias("price"))).drop("price")


@query("WITH c AS (SELECT source, lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3), g AS (SELECT *, min(n) OVER (PARTITION BY source) AS least FROM c) SELECT source, lang, quality, n, CASE WHEN least >= 5 THEN n END AS shown, CASE WHEN n < 5 THEN 'small' WHEN least < 5 THEN 'linked' END AS mark FROM g")
def linked_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of language and quality, linked within a source."""
    met = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.linked_suppression(met.groupBy("source", "lang", "quality").agg(F.count("*").alias("n")), ["source"], "n")


_PLAIN = "(b.business * 0.25 + b.moat * 0.20 + b.strength * 0.15 + b.management * 0.10 + b.valuation * 0.25 + (100.0 - b.risk) * 0.05)"
_ISSUES = f"""
WITH b AS (SELECT o_orderkey AS ticker, o_orderkey % 101 AS business, o_orderkey % 97 AS moat, o_custkey % 101 AS strength, o_orderkey % 89 AS management, CASE WHEN o_orderkey % 50 = 0 THEN 120 ELSE o_custkey % 83 END AS valuation, o_orderkey % 100 AS risk,
                  CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'severe' END AS severity, o_orderpriority, o_orderstatus FROM orders),
s AS (SELECT *, {_PLAIN} AS score FROM b),
v AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN score + 1 ELSE score END AS overall_score, CASE WHEN o_orderpriority = '2-HIGH' THEN 'Hold' WHEN score >= 50 THEN 'Watch' ELSE 'Reject' END AS status,
             CASE WHEN o_orderpriority = '5-LOW' THEN 'old' ELSE 'v' END AS run FROM s),
e AS (SELECT *, valuation <= 100 AS usable, CASE WHEN score >= 70 AND severity <> 'high' THEN 'Investigate' WHEN score >= 50 THEN 'Watch' ELSE 'Reject' END AS want FROM v)
SELECT ticker, 'committee_unknown_status' AS code FROM e WHERE status = 'Hold'
UNION ALL SELECT ticker, 'committee_unknown_severity' FROM e WHERE severity = 'severe'
UNION ALL SELECT ticker, 'committee_invalid_numeric_scores' FROM e WHERE NOT usable
UNION ALL SELECT ticker, 'committee_overall_score_mismatch' FROM e WHERE usable AND overall_score <> score
UNION ALL SELECT ticker, 'committee_status_formula_mismatch' FROM e WHERE usable AND status <> want
UNION ALL SELECT ticker, 'committee_lineage_mismatch' FROM e WHERE run <> 'v'""".replace("b.", "")


@query(_ISSUES)
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as verdicts, with scores from their keys and faults by priority."""
    mod = lambda c, n: F.col(c) % n
    b = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ticker"), mod("o_orderkey", 101).alias("business"), mod("o_orderkey", 97).alias("moat"), mod("o_custkey", 101).alias("strength"), mod("o_orderkey", 89).alias("management"),
        F.when(mod("o_orderkey", 50) == 0, 120).otherwise(mod("o_custkey", 83)).alias("valuation"), mod("o_orderkey", 100).alias("risk"),
        F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").otherwise("severe").alias("severity"), "o_orderpriority",
    )
    b = b.withColumn("score", evaluation.overall_score({c: F.col(c) for c in evaluation.WEIGHTS}))
    is_ = lambda p: F.col("o_orderpriority") == p
    verdicts = b.select(
        "*", (F.col("score") + F.when(is_("1-URGENT"), 1.0).otherwise(0.0)).alias("overall_score"),
        F.when(is_("2-HIGH"), "Hold").when(F.col("score") >= 50, "Watch").otherwise("Reject").alias("status"),
        F.when(is_("5-LOW"), "old").otherwise("v").alias("valuation_run_id"), F.lit("q").alias("quality_run_id"),
    )
    return evaluation.record_issues(verdicts, "v", "q")


# keys and fields


@query("SELECT p_partkey, upper(trim(replace(p_name, '.', '-'))) AS ticker, CASE WHEN regexp_full_match(upper(trim(p_brand)), '[A-Z0-9][A-Z0-9.-]{0,14}') THEN upper(trim(p_brand)) END AS canonical, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, 'https://www.sec.gov/Archives/edgar/data/' || p_partkey || '/' || replace(p_brand, '-', '') || '/' || p_brand || '-index.htm' AS url, replace(p_type || '$', '$', chr(92) || '$') AS escaped FROM part")
def field_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cik = keys.company_key(F.concat(F.lit("CIK "), F.col("p_partkey")))
    return p.select(
        "p_partkey", keys.ticker(F.col("p_name")).alias("ticker"), keys.canonical_ticker(F.col("p_brand")).alias("canonical"), cik.alias("cik"),
        keys.filing_index_url(cik, F.col("p_brand")).alias("url"), keys.escaped_dollars(F.concat("p_type", F.lit("$"))).alias("escaped"),
    )


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 4 MONTH AS DATE) AS before, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS run_id, CAST(o_orderdate AS DATE) AS snapshot FROM orders")
def date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    name = F.concat(F.lit("export_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_all.csv"))
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.months_before(day, 4).alias("before"), keys.run_id(F.col("o_orderdate")).alias("run_id"), keys.snapshot_date(name).alias("snapshot"))


_TIERS = """
WITH x AS (SELECT p_partkey, p_retailprice AS fair, p_retailprice * (0.5 + p_size / 50.0) AS price, p_retailprice * 0.7 AS five, p_retailprice * (1 + p_size / 40.0) AS one, CASE WHEN p_size % 3 > 0 THEN p_brand END AS allocation FROM part),
y AS (SELECT *, CASE WHEN five <> 0 AND one <> 0 THEN round(one / five, 4) END AS width FROM x)
SELECT p_partkey, CASE WHEN fair <> round(fair, 2) OR allocation IS NULL THEN 'quantitative' ELSE 'analyst' END AS tier, concat_ws(',', CASE WHEN fair <> round(fair, 2) THEN 'unrounded_fair_value' END, CASE WHEN allocation IS NULL THEN 'no_capital_allocation' END) AS signals,
       CASE WHEN abs(width - 1.5625) < 0.02 THEN 'Low' WHEN abs(width - 1.9286) < 0.02 THEN 'Medium' WHEN abs(width - 2.5833) < 0.02 THEN 'High' WHEN abs(width - 3.5) < 0.02 THEN 'Very High' WHEN width IS NOT NULL THEN 'OFF_LADDER' END AS uncertainty,
       round(price / fair, 5) AS price_fair_value, round((1 - five / fair) * 100, 1) AS required_margin_pct, CASE WHEN price <= 0 THEN NULL ELSE abs(round(-price * 1000000.0, 0)) END AS capex, round(price / 100, 6) AS margin FROM y"""


@query(_TIERS)
def coverage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fair, size = F.col("p_retailprice"), F.col("p_size")
    x = table(spark, sf_dir, "part").select("p_partkey", fair.alias("fair"), (fair * (0.5 + size / 50.0)).alias("price"), (fair * 0.7).alias("five"), (fair * (1 + size / 40.0)).alias("one"), F.when(size % 3 > 0, F.col("p_brand")).alias("allocation"))
    tier, signals = keys.coverage_tier(F.col("fair"), F.col("allocation"))
    m = keys.price_measures(F.col("price"), F.col("fair"), F.col("five"), F.col("one"))
    unit = lambda f, v: keys.benchmark_unit(F.lit(f), v)
    return x.select(
        "p_partkey", tier.alias("tier"), F.array_join(signals, ",").alias("signals"), keys.band_uncertainty(m["band_width"]).alias("uncertainty"),
        F.round(m["price_fair_value"], 5).alias("price_fair_value"), F.round(m["required_margin_pct"], 1).alias("required_margin_pct"),
        F.round(unit("capex", -F.col("price")), 0).alias("capex"), F.round(unit("roe", F.col("price")), 6).alias("margin"),
    )


@query(f"WITH {PANEL_SQL} SELECT ticker, count(DISTINCT fiscal_year) AS years FROM panel GROUP BY 1 HAVING count(DISTINCT fiscal_year) < 5")
def thin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with fewer than five years."""
    return valuation.thin_history(panel(spark, sf_dir), 5)


_PAIR = "'{\"growth_rate\":' || CAST(CAST(floor(growth * 1000) AS INTEGER) AS VARCHAR) || ',\"projection_years\":10,\"scenario\":\"' || scenario || '\"}'"


@query(_VALUES + f"SELECT ticker, scenario, {_PAIR} AS assumptions FROM values_")
def assumptions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = valuation.scenario_values(panel(spark, sf_dir))
    shape = valuation.assumptions(growth_rate=F.floor(F.col("growth") * 1000).cast("int"), projection_years=F.lit(10), scenario=F.col("scenario"))
    return v.select("ticker", "scenario", shape.alias("assumptions"))
