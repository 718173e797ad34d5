"""Queries of merges, sets, lineage, evaluation and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions.measures import symmetric_difference
from grainledger.operators import committee, evaluation, facts, lineage, series, text, upsert
from grainledger.plans.base import PANEL_SQL, SPEND_SQL, panel, spend
from grainledger.sources.readers import table
from grainledger.sources.writers import portable_digest
from grainledger.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# merges and sets


@query("SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events are a later batch than even ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return upsert.latest_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id")


@query("WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END AS segment FROM customer WHERE c_custkey % 3 <> 1) SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, CASE WHEN n.id IS NOT NULL THEN n.segment ELSE o.segment END AS segment FROM o FULL JOIN n ON o.id = n.id")
def coalesce_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("id % 3 <> 1").select("id", F.when(F.col("id") % 2 == 0, F.upper("name")).alias("name"), F.when(F.col("id") % 5 != 0, "NEW").alias("segment"))
    return upsert.fill_upsert(c.where("id % 3 <> 0"), new, "id", ["name"], ["segment"])


@query("WITH a AS (SELECT c_nationkey AS ticker, min(c_name) AS name, 'customer' AS tags FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS ticker, min(s_name) AS name, 'supplier' AS tags FROM supplier GROUP BY 1) SELECT CAST(coalesce(a.ticker, b.ticker) AS INTEGER) AS ticker, coalesce(a.name, b.name) AS name, CAST(NULL AS VARCHAR) AS sector, concat_ws(',', a.tags, b.tags) AS tags FROM a FULL JOIN b ON a.ticker = b.ticker")
def universe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, k, n, tag: table(spark, sf_dir, t).groupBy(F.col(k).alias("ticker")).agg(F.min(n).alias("name")).select("ticker", "name", F.lit(None).cast("string").alias("sector"), F.lit(tag).alias("tags"))
    return upsert.merged_universe(one("customer", "c_nationkey", "c_name", "customer"), one("supplier", "s_nationkey", "s_name", "supplier"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000)")
def exclusion_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(out, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_custkey AS ticker FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def stage_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ticker")).intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("(SELECT n_nationkey AS k, 'customers only' AS side FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) UNION ALL (SELECT n_nationkey, 'suppliers only' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))")
def sym_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("customers only")).union(b.join(a, "k", "left_anti").withColumn("side", F.lit("suppliers only")))


@query("SELECT e.* FROM (SELECT event_id, user_id, value FROM events) e WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))")
def semi_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the users (runs) that were active in the last hour."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = last.withColumn("all", F.lit(1)).groupBy("all").agg(F.max("last").alias("newest"))
    recent = last.withColumn("all", F.lit(1)).join(newest, "all").where("last >= newest - INTERVAL 1 HOUR").select("user_id")
    return e.join(recent, "user_id", "left_semi").select("event_id", "user_id", "value")


@query("SELECT o_custkey AS ticker, max(o_orderpriority) AS lexical_max FROM orders GROUP BY 1")
def lexical_max_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.max("o_orderpriority").alias("lexical_max"))


@query("SELECT c_custkey AS ticker, coalesce(arg_min(conf, rank), 'low') AS confidence FROM customer LEFT JOIN (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'P' THEN 'medium' ELSE 'low' END AS conf, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS rank FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def ranked_min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.when(F.col("o_orderstatus") == "F", F.struct(F.lit(2).alias("rank"), F.lit("high").alias("c"))).when(F.col("o_orderstatus") == "P", F.struct(F.lit(1).alias("rank"), F.lit("medium").alias("c"))).otherwise(F.struct(F.lit(0).alias("rank"), F.lit("low").alias("c"))).alias("x"))
    worst = o.groupBy("ticker").agg(F.min("x").alias("x"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker")).join(worst, "ticker", "left").select("ticker", F.coalesce("x.c", F.lit("low")).alias("confidence"))


@query("SELECT a.o_custkey AS ticker, column_, round(before, 2) AS before, round(after, 2) AS after FROM (SELECT o_custkey, unnest(['total', 'n']) AS column_, unnest([sum(o_totalprice), count(*)::DOUBLE]) AS before FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey, unnest(['total', 'n']) AS column_b, unnest([sum(o_totalprice), count(*)::DOUBLE]) AS after FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey AND column_ = column_b WHERE abs(before - after) > greatest(1e-9 * greatest(abs(before), abs(after)), 1e-12)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    one = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("ticker")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    got = upsert.snapshot_diff(one(0), one(1), ["ticker"], ["total", "n"])
    return got.select("ticker", F.col("column").alias("column_"), F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


@query("WITH RECURSIVE l AS (SELECT o_orderkey AS run, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders), c AS (SELECT run, run AS root, CAST(0 AS BIGINT) AS hops FROM l WHERE parent IS NULL UNION ALL SELECT l.run, c.root, c.hops + 1 FROM c JOIN l ON l.parent = c.run) SELECT * FROM c")
def reuse_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    links = o.select(F.col("o_orderkey").alias("run"), F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("parent"))
    return lineage.chain_roots(links, "run", "parent")


# restatements


_FACTS = "f AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS filed, value, event_id FROM events)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("ts").cast("date").alias("day"), "event_type", F.from_json("props", "k int")["k"].alias("filed"), "value", "event_id")


@query(f"WITH {_FACTS} SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY filed DESC NULLS LAST, event_id) = 1")
def latest_filed_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.top_row(_facts(spark, sf_dir), ["user_id", "day", "event_type"], F.desc_nulls_last("filed"), F.asc("event_id"))


@query(f"""WITH {_FACTS}, daily AS (SELECT * FROM f WHERE filed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day, filed ORDER BY event_id DESC) = 1),
e AS (SELECT user_id, event_type, day, arg_min(value, filed) AS original, arg_max(value, filed) AS restated FROM daily GROUP BY 1, 2, 3),
r AS (SELECT *, restated / original AS ratio FROM e WHERE original > 0 AND restated <> 0)
SELECT user_id, event_type, day, original, restated, round(ratio, 6) AS ratio, CASE WHEN abs(ratio - 1e3) / 1e3 <= 0.02 OR abs(1 / ratio - 1e3) / 1e3 <= 0.02 OR abs(ratio - 1e6) / 1e6 <= 0.02 OR abs(1 / ratio - 1e6) / 1e6 <= 0.02 OR abs(ratio - 1e9) / 1e9 <= 0.02 OR abs(1 / ratio - 1e9) / 1e9 <= 0.02 THEN 'unit_correction' ELSE 'split' END AS change_type
FROM r WHERE ratio >= 1.4 OR ratio <= 1 / CAST(1.4 AS DOUBLE)""")
def restatement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.restatements(_facts(spark, sf_dir), ["user_id", "event_type"], "day", "value", "filed", "event_id").withColumn("ratio", F.round("ratio", 6))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return got.withColumn("total", F.round("total", 2))


@query("SELECT coalesce(a.k, b.k) AS k, t.trigger, t.before, t.after FROM (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k CROSS JOIN LATERAL (SELECT 'entered' AS trigger, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after WHERE a.k IS NULL UNION ALL SELECT 'left', NULL, NULL WHERE b.k IS NULL UNION ALL SELECT 'n', CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR) WHERE a.n <> b.n UNION ALL SELECT 'p', a.p, b.p WHERE a.p <> b.p) t")
def watchlist_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    one = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return incremental.run_diff(one(0), one(1), "k", ["n", "p"])


# evaluation


@query("WITH a AS (SELECT o_custkey AS k, CASE WHEN sum(o_totalprice) > 1000000 THEN 'pass' ELSE 'fail' END AS state FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1), b AS (SELECT o_custkey AS k, CASE WHEN sum(o_totalprice) > 1000000 THEN 'pass' ELSE 'fail' END AS state FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1), m AS (SELECT coalesce(a.state, 'absent') AS f, coalesce(b.state, 'absent') AS t FROM a FULL JOIN b ON a.k = b.k) SELECT x.s AS from_state, y.s AS to_state, (SELECT count(*) FROM m WHERE f = x.s AND t = y.s) AS n FROM (VALUES ('pass'), ('fail'), ('absent')) x(s) CROSS JOIN (VALUES ('pass'), ('fail'), ('absent')) y(s) WHERE NOT (x.s = 'absent' AND y.s = 'absent')")
def paired_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.sum("o_totalprice") > 1_000_000, "pass").otherwise("fail").alias("state")
    early, late = (o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(state) for c in ("year(o_orderdate) < 1998", "year(o_orderdate) >= 1998"))
    return evaluation.transitions(early, late, "k", "state", ["pass", "fail"])


@query("WITH d AS (SELECT doc_id, n_chars > 1500 AS passed, quality = 1 AS good FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE passed) AS passed, count(good) AS rated, count(*) FILTER (WHERE passed AND good) AS hits, count(*) FILTER (WHERE passed AND good IS NOT NULL) AS pr, count(*) FILTER (WHERE good) AS lt FROM d) SELECT n, passed, rated, hits, round(hits / pr, 6) AS precision, round(hits / lt, 6) AS recall, round(lt / rated, 6) AS base_rate, round((hits / pr) / (lt / rated), 6) AS lift, round((n - rated) / n, 6) AS unrated_rate FROM c")
def contingency_precision_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    got = evaluation.precision_and_lift(d, F.col("n_chars") > 1500, F.col("quality") == 1)
    return got.select("n", "passed", "rated", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "base_rate", "lift", "unrated_rate")])


@query(f"WITH {SPEND_SQL}, b AS (SELECT s.sector, s.spend, c_acctbal AS bal FROM spend s JOIN customer ON c_custkey = ticker WHERE s.spend IS NOT NULL), r AS (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY spend) + (count(*) OVER (PARTITION BY sector, spend) - 1) / 2.0 AS x, rank() OVER (PARTITION BY sector ORDER BY bal) + (count(*) OVER (PARTITION BY sector, bal) - 1) / 2.0 AS y FROM b) SELECT sector, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spend(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), "c_acctbal"), "ticker")
    return evaluation.spearman(rows, "spend", "c_acctbal", ["sector"]).withColumn("rho", F.round("rho", 6))


@query("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice)").alias("p95"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.25), 4).alias("p25"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.median("o_totalprice"), 4).alias("median"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query()
def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded resampling has no SQL; tests hold it against its own seed and the mean's standard error."""
    return evaluation.bootstrap_interval(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")


#: Fixed values once more, for the SQL: the weights of the scores, and which scores are whose.
_WEIGHTS = {"business": 0.25, "moat": 0.20, "strength": 0.15, "management": 0.10, "valuation": 0.25, "risk": 0.05}
_PERSONAS = {"quality": ("business", "moat", "management"), "valuation": ("strength", "valuation"), "bear": ("risk",)}
_SCORED = "scored AS (SELECT c_custkey AS ticker, (c_acctbal + 1000) / 110 AS business, CAST(c_custkey % 101 AS DOUBLE) AS moat, CAST(c_nationkey * 4 AS DOUBLE) AS strength, 50.0::DOUBLE AS management, CAST(c_custkey % 97 AS DOUBLE) AS valuation, CAST(c_custkey % 89 AS DOUBLE) AS risk, CASE WHEN c_custkey % 7 = 0 THEN 'high' WHEN c_custkey % 7 < 4 THEN 'medium' ELSE 'low' END AS severity FROM customer)"


def _sum(values: dict[str, str]) -> str:
    """SQL of the weighted score of these values, over their weights."""
    said = " + ".join(f"{_WEIGHTS[k]} * ({f'100 - {v}' if k == 'risk' else v})" for k, v in values.items())
    return f"({said}) / CAST({sum(_WEIGHTS[k] for k in values)} AS DOUBLE)"


def _scenario_sql() -> str:
    plain = {k: k for k in _WEIGHTS}
    found = {"as_is": (_sum(plain), True)}
    for persona, own in _PERSONAS.items():
        found[f"{persona}_median"] = _sum(plain | {k: f"m_{k}" for k in own}), True
        found[f"{persona}_midpoint"] = _sum(plain | {k: "50.0" for k in own}), True
        found[f"{persona}_nothing"] = _sum(plain | {k: "100.0" if k == "risk" else "0.0" for k in own}), True
        found[f"{persona}_left_out"] = _sum({k: k for k in _WEIGHTS if k not in own}), True
    found["bear_cap_off"] = _sum(plain), False
    found["bear_gone"] = _sum({k: k for k in _WEIGHTS if k != "risk"}), False
    one = "SELECT ticker, '{n}' AS scenario, {e} AS score, severity = 'high' AND {c} AS held FROM s"
    return " UNION ALL ".join(one.format(n=n, e=e, c=str(c).upper()) for n, (e, c) in found.items())


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("ticker"), ((F.col("c_acctbal") + 1000) / 110).alias("business"), (k % 101).cast("double").alias("moat"), (F.col("c_nationkey") * 4).cast("double").alias("strength"),
        F.lit(50.0).alias("management"), (k % 97).cast("double").alias("valuation"), (k % 89).cast("double").alias("risk"), F.when(k % 7 == 0, "high").when(k % 7 < 4, "medium").otherwise("low").alias("severity"),
    )


@query(f"WITH {_SCORED} SELECT ticker, round(score, 7) AS score, CASE WHEN score >= 70 THEN CASE WHEN severity = 'high' THEN 'watch' ELSE 'investigate' END WHEN score >= 50 THEN 'watch' ELSE 'reject' END AS status FROM (SELECT *, {_sum({k: k for k in _WEIGHTS})} AS score FROM scored)")
def weighted_score_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    score = evaluation.overall_score({s: F.col(s) for s in evaluation.WEIGHTS})
    return rows.withColumn("score", score).select("ticker", F.round("score", 7).alias("score"), evaluation.verdict_status(F.col("score"), F.col("severity")).alias("status"))


@query(f"WITH {_SCORED}, m AS (SELECT {', '.join(f'median({k}) AS m_{k}' for k in _WEIGHTS)} FROM scored), s AS (SELECT * FROM scored CROSS JOIN m), x AS ({_scenario_sql()}) SELECT ticker, scenario, round(score, 7) AS score, CASE WHEN score >= 70 THEN CASE WHEN held THEN 'watch' ELSE 'investigate' END WHEN score >= 50 THEN 'watch' ELSE 'reject' END AS status FROM x")
def counterfactual_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.counterfactuals(_scored(spark, sf_dir), "ticker").withColumn("score", F.round("score", 7))


@query("""SELECT c_custkey AS ticker, CASE WHEN c_acctbal < -900 THEN 'abstain' WHEN c_acctbal > 8000 THEN 'pass' WHEN c_nationkey < 6 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'unassessable-definitional' ELSE 'unassessable-datagap' END WHEN c_acctbal / 100 >= 33 THEN 'fail-boundary' ELSE 'fail-clear' END AS stratum,
CASE WHEN c_nationkey % 5 = 0 THEN 'abstain' WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'contradicted' WHEN c_custkey % 4 = 1 THEN 'abstain' WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 1 THEN 'strong' WHEN c_custkey % 4 = 3 AND c_custkey % 3 = 1 THEN 'weak' ELSE 'ambiguous' END AS support FROM customer""")
def strata_and_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sector = F.when(F.col("c_mktsegment") == "BUILDING", "Financials").otherwise(F.col("c_mktsegment"))
    moat = F.when(k % 4 == 0, "None").when(k % 4 == 2, "Wide").when(k % 4 == 3, "Narrow")
    value = F.when(k % 3 == 0, "expensive").when(k % 3 == 1, "cheap").otherwise("fair")
    tier = F.when(F.col("c_nationkey") % 5 == 0, "quantitative").otherwise("analyst")
    return c.select(k.alias("ticker"), evaluation.stratum(F.col("c_acctbal") >= -900, F.col("c_acctbal") > 8000, F.col("c_nationkey"), F.col("c_acctbal") / 100, sector).alias("stratum"), evaluation.external_support(moat, value, tier).alias("support"))


_STARS = """stars AS (SELECT o_orderkey AS id, o_orderpriority AS cohort, o_totalprice AS price, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice * (7 + o_orderkey % 7) / 10 END AS five, o_totalprice * (8 + o_custkey % 6) / 10 AS one, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * (8 + o_custkey % 5) / 10 END AS fair FROM orders),
ruled AS (SELECT *, CASE WHEN NOT coalesce(price > 0 AND five > 0 AND one > 0, FALSE) THEN 'unusable input' WHEN NOT five < one THEN 'band out of order' WHEN price <= five THEN 'at or below five stars' WHEN price > one THEN 'above one star' ELSE 'between' END AS rule, CASE WHEN fair IS NULL THEN 'unavailable' WHEN price <= fair THEN 'at or below' ELSE 'above' END AS direction FROM stars),
classed AS (SELECT id, cohort, CASE rule WHEN 'at or below five stars' THEN 'cheap' WHEN 'above one star' THEN 'expensive' WHEN 'between' THEN 'fair' ELSE 'abstain' END AS class, rule, direction FROM ruled)"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    five, fair = F.when(k % 11 != 0, price * (7 + k % 7) / 10), F.when(k % 13 != 0, price * (8 + c % 5) / 10)
    cls, rule, direction = evaluation.star_class(price, five, price * (8 + c % 6) / 10, fair)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("cohort"), cls.alias("class"), rule.alias("rule"), direction.alias("direction"))


@query(f"WITH {_STARS} SELECT * FROM classed")
def star_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stars(spark, sf_dir)


@query(f"""WITH {_STARS}, o AS (SELECT c.*, o_orderstatus AS st FROM classed c JOIN orders ON o_orderkey = id),
p AS (SELECT cohort, CASE st WHEN 'F' THEN 'cheap' WHEN 'O' THEN 'fair' ELSE 'expensive' END AS own, class AS bench, CASE st WHEN 'F' THEN 'at or below' ELSE 'above' END AS od, direction AS bd FROM o),
r AS (SELECT cohort, CASE own WHEN 'cheap' THEN 2 WHEN 'fair' THEN 1 ELSE 0 END AS x, CASE bench WHEN 'cheap' THEN 2 WHEN 'fair' THEN 1 ELSE 0 END AS y FROM p WHERE bench <> 'abstain'),
k AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY x) + (count(*) OVER (PARTITION BY cohort, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY cohort ORDER BY y) + (count(*) OVER (PARTITION BY cohort, y) - 1) / 2.0 AS ry FROM r),
rho AS (SELECT cohort, corr(rx, ry) AS rho FROM k GROUP BY 1)
SELECT p.cohort, count(*) AS eligible, count(*) FILTER (WHERE bench <> 'abstain') AS scored, round(count(*) FILTER (WHERE bench <> 'abstain') / count(*), 6) AS coverage, round(count(*) FILTER (WHERE bench = own) / count(*) FILTER (WHERE bench <> 'abstain'), 6) AS exact,
round(count(*) FILTER (WHERE own = 'cheap' AND bench NOT IN ('cheap', 'abstain')) / count(*) FILTER (WHERE own = 'cheap' AND bench <> 'abstain'), 6) AS false_cheap, round(any_value(rho), 6) AS rho,
round(count(*) FILTER (WHERE bench <> 'abstain' AND bd = od) / count(*) FILTER (WHERE bench <> 'abstain' AND bd <> 'unavailable'), 6) AS direction FROM p JOIN rho ON rho.cohort = p.cohort GROUP BY 1""")
def agreement_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's status stands for our own class."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "cheap").when(F.col("o_orderstatus") == "O", "fair").otherwise("expensive").alias("own_class"))
    rows = _stars(spark, sf_dir).withColumnsRenamed({"class": "bench_class", "direction": "bench_direction"}).join(own, "id")
    got = evaluation.agreement(rows.withColumn("own_direction", F.when(F.col("own_class") == "cheap", "at or below").otherwise("above")), ["cohort"])
    return got.select("cohort", "eligible", "scored", *[F.round(c, 6).alias(c) for c in ("coverage", "exact", "false_cheap", "rho", "direction")])


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_discount AS x, l_tax AS y FROM lineitem) SELECT l_orderkey, l_linenumber, round(abs(x - y), 6) AS absolute, CASE WHEN abs(x) > 0.0001 AND abs(y) > 0.0001 THEN round(2 * abs(x - y) / (abs(x) + abs(y)), 6) END AS relative, (x = 0 AND y = 0) OR (x > 0) = (y > 0) AS same_sign, CASE WHEN x <> 0 AND y <> 0 THEN round(abs(log10(abs(x)) - log10(abs(y))), 6) END AS magnitudes, abs(x) <= 0.0001 OR abs(y) <= 0.0001 AS near_zero,
CASE WHEN abs(x - y) <= 0.01 AND ((x = 0 AND y = 0) OR (x > 0) = (y > 0) OR (abs(x) <= 0.0001 AND abs(y) <= 0.0001)) THEN 'match' ELSE 'probable defect' END AS outcome FROM d""")
def figure_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.comparison(F.col("l_discount"), F.col("l_tax"), evaluation.NEAR_ZERO)
    number = {n: F.round(d[n], 6) for n in ("absolute", "relative", "magnitudes")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in (d | number).items()], evaluation.ratio_outcome(F.col("l_discount"), F.col("l_tax")).alias("outcome"))


@query(f"WITH {PANEL_SQL} SELECT ticker, fiscal_year, CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 AND equity + lag(equity) OVER w <> 0 THEN round(net_income / ((equity + lag(equity) OVER w) / 2), 6) END AS roe FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)")
def average_equity_roe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_equity_roe(panel(spark, sf_dir), ["ticker"]).withColumn("roe", F.round("roe", 6))


_DELTA = "d AS (SELECT coalesce(a.k, b.k) AS k, round(abs(a.v - b.v), 2) AS delta FROM (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k)"


@query(f"WITH {_DELTA} SELECT k, delta, CASE WHEN delta <= (SELECT quantile_disc(delta, 0.95) FROM d) THEN 'within noise' ELSE 'above noise' END AS label FROM d")
def noise_boundary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    one = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias(f"v{r}"))
    d = one(0).join(one(1), "k").select("k", F.round(F.abs(F.col("v0") - F.col("v1")), 2).alias("delta"))
    edge = d.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY delta)").alias("edge"))
    return d.crossJoin(F.broadcast(edge)).select("k", "delta", F.when(F.col("delta") <= F.col("edge"), "within noise").otherwise("above noise").alias("label"))  # one row


@query("WITH y AS (SELECT o_custkey AS k, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996), 2) AS x, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997), 2) AS z FROM orders GROUP BY 1) SELECT k, CASE WHEN x = 0 AND z = 0 THEN 0.0 ELSE round(2 * abs(x - z) / (abs(x) + abs(z)), 6) END AS difference, CASE WHEN x IS NULL OR z IS NULL THEN 'unavailable' WHEN 2 * abs(x - z) / (abs(x) + abs(z)) <= 0.1 THEN 'close' WHEN 2 * abs(x - z) / (abs(x) + abs(z)) <= 0.5 THEN 'apart' ELSE 'far' END AS outcome FROM y")
def symmetric_difference_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda y: F.round(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))), 2)
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(of(1996).alias("x"), of(1997).alias("z"))
    d = symmetric_difference("x", "z")
    return rows.select("k", F.round(d, 6).alias("difference"), F.when(d.isNull(), "unavailable").when(d <= 0.1, "close").when(d <= 0.5, "apart").otherwise("far").alias("outcome"))


@query("SELECT lang, source, n, CASE WHEN min(n) OVER (PARTITION BY lang) >= 5 THEN n END AS shown FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)")
def small_cell_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return evaluation.suppressed(counts, ["lang"], "n")


@query("SELECT conv_id, turn, role, CAST(coalesce(sum(length(text)) OVER w, 0) AS DOUBLE) AS spent_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY spent_before < 600")
def cost_cap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's length stands for its cost; a conversation stops when 600 are spent."""
    c = table(spark, sf_dir, "conversations").withColumn("cost", F.length("text").cast("double"))
    return series.running_prefix(c, ["conv_id"], "cost", 600.0, F.asc("turn")).select("conv_id", "turn", "role", "spent_before")


@query("SELECT source, min(n) AS halted_after FROM (SELECT source, row_number() OVER w AS n, count(*) FILTER (WHERE n_chars < 600) OVER w AS short FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE n >= 5 AND short / n > 0.1 GROUP BY 1")
def fallback_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After how many documents of a source more than a tenth were short ones."""
    d = series.value_counts(table(spark, sf_dir, "documents"), ["source"], "doc_id", tally=F.col("n_chars") < 600)
    return d.where("upto >= 5 and tally_upto / upto > 0.1").groupBy("source").agg(F.min("upto").cast("long").alias("halted_after"))


# text


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with the documents that hold them."""
    return text.quoted(*_passages(spark, sf_dir))


_STARTS = """hits AS (
  SELECT doc_id, item_id, d.text, b.text AS quote, strpos(d.text, b.text) AS at_ FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  UNION ALL SELECT doc_id, item_id, text, quote, at_ + strpos(substr(text, at_ + 1), quote) FROM hits WHERE strpos(substr(text, at_ + 1), quote) > 0)"""


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place where a document holds a passage, also where places overlap; at from 0."""
    return _quotes(spark, sf_dir).select("doc_id", "item_id", "text", "quote", F.explode(text.find_all("text", "quote")).alias("at"))


@query(f"WITH RECURSIVE {_STARTS} SELECT doc_id, item_id, CAST(at_ - 1 AS INTEGER) AS start_ FROM hits")
def quote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(spark, sf_dir).select("doc_id", "item_id", F.col("at").alias("start_"))


@query(f"WITH RECURSIVE {_STARTS} SELECT doc_id, item_id, CAST(at_ - 1 AS INTEGER) AS start_, substr(text, greatest(at_ - 48, 1), least(at_ - 1, 48)) AS prefix, substr(text, at_ + length(quote), 48) AS suffix, sha256(quote) AS quote_sha256 FROM hits")
def quote_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before and behind each place, and the passage's hash."""
    low = F.greatest(F.col("at") - text.CONTEXT, F.lit(0))
    return _starts(spark, sf_dir).select(
        "doc_id", "item_id", F.col("at").alias("start_"), F.substring(F.col("text"), low + 1, F.col("at") - low).alias("prefix"),
        F.substring(F.col("text"), F.col("at") + F.length("quote") + 1, F.lit(text.CONTEXT)).alias("suffix"), F.sha2("quote", 256).alias("quote_sha256"),
    )


@query("SELECT item_id, count(*) AS documents, count(*) = 1 AS unique_ FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def quote_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents")).withColumn("unique_", F.col("documents") == 1)


@query()
def quote_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages against documents that hold them but for white space or wording; each with its longest shared run."""
    return text.fuzzy_quoted(*_passages(spark, sf_dir))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal FROM conversations")
def claim_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")).cast("long").alias("ordinal"))


_REPLIES = """
turns AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, turn % 5 AS kind, turn // 5 AS part, length(text) AS n FROM conversations WHERE turn IS NOT NULL),
heads AS (SELECT conv_id, part, max(CASE WHEN kind = 0 THEN ['business_quality', 'moat', 'management', 'risk'][(conv_id + part) % 4 + 1] END) AS section FROM turns GROUP BY 1, 2),
kinds AS (SELECT t.*, h.section, max(kind = 0) OVER (PARTITION BY t.conv_id, t.part) AS headed FROM turns t JOIN heads h USING (conv_id, part)),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) AS INTEGER) AS ordinal FROM kinds WHERE kind > 0 AND section IS NOT NULL AND body <> '')"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reply_id, blocks: a conversation as a reply; by place in fives, a turn opens a section, is cited, uncited, lacks evidence, or is cited in one block with its prefix."""
    c = table(spark, sf_dir, "conversations").where("turn is not null")
    kind, part, said = F.col("turn") % 5, F.floor(F.col("turn") / 5), F.coalesce("text", F.lit(""))
    heading = F.element_at(F.array(*[F.lit(h) for h in text.REPLY_SECTIONS]), ((F.col("conv_id") + part) % 4 + 1).cast("int"))
    words = F.when(kind == 0, F.concat(F.lit("Now:\n## "), heading, F.lit("\n\nCLAIM: "))).when(kind == 1, said).when(kind == 2, F.concat(F.lit("claim: "), said, F.lit("\n\n---\n"))).when(kind == 3, F.concat(F.lit("Insufficient evidence: "), said)).otherwise(F.concat(F.lit("As said, CLAIM: "), said))
    cite = F.struct(F.lit("char_location").alias("type"), F.col("turn").cast("int").alias("document_index"), F.lit(0).alias("start_char_index"), F.length(said).alias("end_char_index"), said.alias("cited_text"))
    cites = F.when(kind.isin(1, 4), F.array(cite)).otherwise(F.array().cast("array<struct<type:string,document_index:int,start_char_index:int,end_char_index:int,cited_text:string>>"))
    blocks = c.select("conv_id", F.struct("turn", F.lit("text").alias("type"), words.alias("text"), cites.alias("citations")).alias("b"))
    return blocks.groupBy(F.col("conv_id").alias("reply_id")).agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["citations"].alias("citations"))).alias("blocks"))


@query(f"WITH {_REPLIES} SELECT conv_id AS reply_id, section, CAST(ordinal AS INTEGER) AS ordinal, body AS claim, CASE kind WHEN 3 THEN 'insufficient_evidence' ELSE 'asserted' END AS status, CASE WHEN kind IN (1, 4) THEN 1 ELSE 0 END AS citations FROM found")
def turn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of conversations read as replies."""
    return _replies(spark, sf_dir).select("reply_id", F.inline(text.claims("blocks"))).select("reply_id", "section", "ordinal", "claim", "status", F.size("citations").alias("citations"))


@query(f"""WITH {_REPLIES}, r AS (SELECT DISTINCT conv_id FROM turns), s(section) AS (VALUES ('business_quality'), ('moat'), ('management'), ('risk'))
SELECT conv_id AS reply_id, 'truncated' AS code, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS INTEGER) AS ordinal FROM r WHERE conv_id % 9 = 2
UNION ALL SELECT conv_id, 'missing_section', section, NULL FROM r CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.conv_id = r.conv_id AND f.section = s.section)
UNION ALL SELECT conv_id, 'uncited', section, ordinal FROM found WHERE kind = 2
UNION ALL SELECT conv_id, CASE WHEN turn = 6 THEN 'unknown_document' WHEN conv_id % 4 = 1 THEN 'out_of_range' ELSE 'text_differs' END, section, ordinal FROM found WHERE kind IN (1, 4) AND (turn = 6 OR (n > 0 AND conv_id % 4 IN (1, 3)))""")
def reply_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that end early, lack a section or a citation, or cite what their documents don't have: some documents are short of a character, or another."""
    replies = _replies(spark, sf_dir)
    found = replies.select("reply_id", F.inline(text.claims("blocks")))
    cited = found.select("reply_id", "section", "ordinal", F.inline("citations")).select(F.struct("reply_id", "section", "ordinal").alias("claim_id"), F.struct("reply_id", F.col("document_index").cast("long").alias("turn")).alias("document_id"), "start_char", "end_char", "cited_text")
    said, k = F.col("text"), F.col("conv_id") % 4
    kept = F.when(k == 1, F.expr("substring(text, 1, length(text) - 1)")).when(k == 3, F.concat(F.lit("\u0001"), F.expr("substring(text, 2)"))).otherwise(said)
    documents = table(spark, sf_dir, "conversations").where("turn <> 6").select(F.struct(F.col("conv_id").alias("reply_id"), "turn").alias("document_id"), kept.alias("text"))
    wrong = text.resolved_citations(cited, documents).select("claim_id.*", "error")
    ended = replies.select("reply_id", F.when(F.col("reply_id") % 9 == 2, "max_tokens").otherwise("end_turn").alias("stop_reason"))
    return text.reply_issues(ended, found, wrong)


@query()
def html_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalise("html").alias("text"))


@query("SELECT conv_id, sha256(string_agg(length(text)::VARCHAR || ':' || text, '|' ORDER BY turn)) AS bundle FROM conversations GROUP BY 1")
def bundle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    parts = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.length(x["text"]).cast("string"), F.lit(":"), x["text"])).alias("parts"))
    return parts.select("conv_id", F.sha2(F.array_join("parts", "|"), 256).alias("bundle"))


@query("SELECT role, round(sum(length(text) * CASE role WHEN 'user' THEN 3.0 WHEN 'assistant' THEN 15.0 ELSE 1.0 END / 1e6 * CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 1.0 END), 6) AS cost FROM conversations GROUP BY 1")
def cost_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("user", 3.0, 0.0), ("assistant", 15.0, 0.0), ("system", 1.0, 0.0)], "model string, input_price double, output_price double")
    usage = table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.length("text").alias("input_tokens"), F.lit(0).alias("output_tokens"), (F.col("conv_id") % 2 == 0).alias("batch"))
    return committee.cost(usage, prices).groupBy(F.col("model").alias("role")).agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("WITH k AS (SELECT conv_id, count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant')) AS kinds, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id AS ticker, CASE WHEN kinds < 2 THEN 'analysis missing' WHEN last < 2 THEN 'valuation missing' WHEN conv_id % 5 = 0 THEN 'cached' ELSE 'call' END AS gate FROM k")
def committee_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "ticker")
    return committee.gates(c, c.withColumnRenamed("role", "analysis_type"), c.where("turn >= 2"), c.where("ticker % 5 = 0"), ["user", "assistant"])


@query("""WITH r AS (SELECT ['k' || o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR), o_comment] AS cells FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_comment FROM orders)),
h AS (SELECT ('0x' || left(sha256(array_to_string(list_transform(cells, lambda c: coalesce(length(c) || ':' || c, '-')), '|')), 15))::BIGINT AS h FROM r)
SELECT count(*) AS n, coalesce(bit_xor(h), 0) AS mixed, coalesce(sum(h), 0)::VARCHAR AS summed FROM h""")
def upstream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells whether the orders have changed, whatever the order of their rows."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), k.cast("string")).alias("k"), "o_orderstatus", F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("price"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    return portable_digest(rows)
