"""Queries of valuation: owner earnings, scenarios, multiples, safety, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.functions.measures import ev_to_ebit, fcf_yield, margin_of_safety, owner_earnings, price_to_earnings, weekdays_between
from grainledger.operators import valuation
from grainledger.plans.base import PANEL_SQL, panel
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


@query(f"WITH {PANEL_SQL} SELECT ticker, fiscal_year, round(net_income + depreciation - capex - coalesce(working_capital_change, 0), 4) AS owner_earnings FROM panel")
def owner_earnings_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("ticker", "fiscal_year", F.round(owner_earnings("net_income", "depreciation", "capex", "working_capital_change"), 4).alias("owner_earnings"))


_TERMS = " + ".join(f"pow(1 + growth, {i}) / pow(1.095, {i})" for i in range(1, 11))
_VALUES = f"""
WITH {PANEL_SQL},
positive AS (SELECT ticker, min(fiscal_year) AS y1, arg_min(revenue, fiscal_year) AS v1, max(fiscal_year) AS y2, arg_max(revenue, fiscal_year) AS v2 FROM panel WHERE revenue > 0 GROUP BY ticker),
rate AS (SELECT ticker, CASE WHEN y2 > y1 THEN pow(v2 / v1, 1.0 / (y2 - y1)) - 1 END AS rate FROM positive),
base AS (
  SELECT ticker, avg(net_income + depreciation - capex - coalesce(working_capital_change, 0)) AS base
  FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) <= 10) GROUP BY ticker),
grown AS (
  SELECT b.ticker, scenario, base, terminal, greatest(least(greatest(least(coalesce(rate, 0.0), 0.2), -0.1) + spread, 0.2), -0.1) AS growth
  FROM base b LEFT JOIN rate r ON r.ticker = b.ticker
  CROSS JOIN (VALUES ('bear', -0.04, 0.015), ('base', 0.0, 0.025), ('bull', 0.04, 0.03)) s(scenario, spread, terminal)),
values_ AS (
  SELECT ticker, scenario, growth, base, base * ({_TERMS}) + base * pow(1 + growth, 10) * (1 + terminal) / (0.095 - terminal) / pow(1.095, 10) AS value FROM grown)
"""


@query(_VALUES + "SELECT ticker, scenario, round(growth, 6) AS growth, round(base, 3) AS base, round(value, 2) AS value FROM values_")
def dcf_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.scenario_values(panel(spark, sf_dir)).select("ticker", "scenario", F.round("growth", 6).alias("growth"), F.round("base", 3).alias("base"), F.round("value", 2).alias("value"))


@query("SELECT p_partkey, p_retailprice AS low, s.price, CASE WHEN p_retailprice > 0 THEN round((p_retailprice - s.price) / p_retailprice, 6) END AS margin FROM part JOIN (SELECT l_partkey, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey")
def margin_of_safety_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("price"))
    rows = table(spark, sf_dir, "part").join(last, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("p_partkey", F.col("p_retailprice").alias("low"), "price", F.round(margin_of_safety("p_retailprice", "price"), 6).alias("margin"))


@query(f"WITH {PANEL_SQL} SELECT ticker, fiscal_year, CASE WHEN revenue > 0 THEN round(free_cash_flow / revenue, 6) END AS fcf_yield, CASE WHEN revenue > 0 AND operating_income > 0 THEN round((revenue + total_debt - coalesce(cash, 0)) / operating_income, 4) END AS ev_to_ebit, CASE WHEN eps > 0 THEN round(100 / eps, 6) END AS pe FROM panel")
def multiples_with_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue stands in for the market value, 100 for the price."""
    return panel(spark, sf_dir).select("ticker", "fiscal_year", F.round(fcf_yield("free_cash_flow", "revenue"), 6).alias("fcf_yield"), F.round(ev_to_ebit("revenue", "total_debt", "cash", "operating_income"), 4).alias("ev_to_ebit"), F.round(price_to_earnings(F.lit(100.0), "eps"), 6).alias("pe"))


_DAILY = "daily AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY 1, 2)"


@query(f"WITH {PANEL_SQL}, {_DAILY}, priced AS (SELECT p.ticker, close / eps AS pe FROM panel p ASOF JOIN daily d ON p.ticker = d.ticker AND p.period_end_date >= d.date WHERE eps > 0) SELECT ticker, round(min(pe), 4) AS pe_low, round(max(pe), 4) AS pe_high, count(*) AS pe_years, count(*) < 5 AS low_confidence FROM priced GROUP BY ticker")
def pe_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _daily(spark, sf_dir)
    return valuation.past_multiples(panel(spark, sf_dir), prices).withColumn("pe_low", F.round("pe_low", 4)).withColumn("pe_high", F.round("pe_high", 4))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("close"))


@query(_VALUES + f""", {_DAILY}, last AS (SELECT ticker, arg_max(close, date) AS price FROM daily GROUP BY ticker),
wide AS (SELECT v.ticker, max(CASE WHEN scenario = 'bear' THEN value END) AS bear, max(CASE WHEN scenario = 'base' THEN value END) AS mid, max(CASE WHEN scenario = 'bull' THEN value END) AS bull, count(*) AS n, any_value(price) AS price FROM values_ v LEFT JOIN last l ON l.ticker = v.ticker GROUP BY v.ticker),
why AS (SELECT *, CASE WHEN bear IS NULL OR mid IS NULL OR bull IS NULL THEN 'unknown value' WHEN bear <= 0 OR mid <= 0 OR bull <= 0 THEN 'value not positive' WHEN bear >= mid OR mid >= bull THEN 'scenarios out of order' WHEN price IS NULL OR NOT price > 0 THEN 'no price' END AS reason FROM wide)
SELECT ticker, CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN price <= bear THEN 'cheap' WHEN price >= bull THEN 'expensive' ELSE 'fair' END AS class, reason FROM why""")
def valuation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = valuation.scenario_values(panel(spark, sf_dir))
    at = lambda n: F.max(F.when(F.col("scenario") == n, F.col("value"))).alias(n)
    price = _daily(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    wide = values.groupBy("ticker").agg(at("bear"), at("base"), at("bull"), F.count("*").alias("n")).join(price, "ticker", "left")
    cls, reason = valuation.value_class(F.col("bear"), F.col("base"), F.col("bull"), F.col("price"), F.col("n"), F.lit(True))
    return wide.select("ticker", cls.alias("class"), reason.alias("reason"))


@query(_VALUES + f""", {_DAILY}, last AS (SELECT ticker, arg_max(close, date) AS price FROM daily GROUP BY ticker),
latest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) = 1),
good AS (SELECT l.*, price FROM latest l JOIN last USING (ticker) WHERE shares > 0),
mult AS (SELECT p.ticker, min(close / eps) AS lo, max(close / eps) AS hi FROM panel p ASOF JOIN daily d ON p.ticker = d.ticker AND p.period_end_date >= d.date WHERE eps > 0 GROUP BY p.ticker),
six AS (
 SELECT v.ticker, 'dcf' AS method, scenario, value / shares AS low, value / shares AS high, CASE WHEN value / shares > 0 THEN (value / shares - price) / (value / shares) END AS margin FROM values_ v JOIN good g ON g.ticker = v.ticker
 UNION ALL SELECT ticker, 'fcf_yield', NULL, CASE WHEN price * shares > 0 THEN free_cash_flow / (price * shares) END, CASE WHEN price * shares > 0 THEN free_cash_flow / (price * shares) END, NULL FROM good
 UNION ALL SELECT ticker, 'ev_to_ebit', NULL, CASE WHEN operating_income > 0 THEN (price * shares + total_debt - coalesce(cash, 0)) / operating_income END, CASE WHEN operating_income > 0 THEN (price * shares + total_debt - coalesce(cash, 0)) / operating_income END, NULL FROM good
 UNION ALL SELECT g.ticker, 'pe_range', NULL, CASE WHEN eps > 0 THEN lo * eps END, CASE WHEN eps > 0 THEN hi * eps END, CASE WHEN CASE WHEN eps > 0 THEN lo * eps END > 0 THEN (lo * eps - price) / (lo * eps) END FROM good g LEFT JOIN mult m ON m.ticker = g.ticker)
SELECT ticker, method, scenario, round(low, 3) AS low, round(high, 3) AS high, round(margin, 4) AS margin FROM six""")
def six_valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = valuation.valuations(panel(spark, sf_dir), _daily(spark, sf_dir), parts_of(table(spark, sf_dir, "orders")))
    return rows.select("ticker", "method", "scenario", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), F.round("margin_of_safety", 4).alias("margin"))


@query("SELECT part, last, CAST(days AS INTEGER) AS behind, days > 3 AS stale FROM (SELECT l_partkey AS part, CAST(max(l_shipdate) AS DATE) AS last, len(list_filter(generate_series(CAST(max(l_shipdate) AS DATE) + 1, DATE '2001-10-31' - 1, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS days FROM lineitem GROUP BY 1)")
def price_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_shipdate").cast("date").alias("last"))
    behind = weekdays_between("last", F.lit("2001-10-31").cast("date"))
    return last.select("part", "last", behind.alias("behind"), (behind > 3).alias("stale"))
