"""The annual panel over the supplied tables, as a plan and as SQL.

Company: customer; sector: market segment; fiscal year: year of the order. Measures are sums over the year's order lines,
rounded to the digits that their products have, so that the order of summation doesn't show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.session import dealt, parts_of
from grainledger.sources.readers import table

#: name: (what is summed for each line, digits)
MEASURES = {
    "revenue": ("l_extendedprice", 2),
    "net_income": ("l_extendedprice * (0.06 - l_discount)", 4),
    "operating_income": ("l_extendedprice * (0.08 - l_discount)", 4),
    "operating_cash_flow": ("l_extendedprice * l_tax", 4),
    "capex": ("l_quantity * 20", 2),
    "depreciation": ("CASE WHEN l_linestatus = 'F' THEN l_quantity * 5 END", 2),
    "working_capital_change": ("CASE WHEN l_returnflag = 'N' THEN l_quantity END", 2),
    "total_debt": ("CASE WHEN l_returnflag = 'R' THEN l_extendedprice END", 2),
    "cash": ("CASE WHEN l_returnflag = 'A' THEN l_extendedprice * l_discount END", 4),
    "equity": ("CASE WHEN l_linestatus = 'O' THEN l_extendedprice END", 2),
    "shares": ("l_quantity", 2),
}
_SUMS = ", ".join(f"round(sum({e}), {d}) AS {n}" for n, (e, d) in MEASURES.items())
PANEL_SQL = f"""
panel AS (
  SELECT p.*, net_income / shares AS eps, operating_cash_flow - capex AS free_cash_flow,
         CASE WHEN revenue <> 0 THEN operating_income / revenue END AS operating_margin,
         CASE WHEN revenue > 0 AND ((net_income > 0 AND net_income > revenue) OR (operating_income > 0 AND operating_income > revenue)) THEN 1 ELSE 0 END AS implausible
  FROM (SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, c_mktsegment AS sector,
               CAST(max(o_orderdate) AS DATE) AS period_end_date, {_SUMS}
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
        GROUP BY o_custkey, year(o_orderdate), c_mktsegment) p)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ticker"), "o_orderdate")
    lines, customers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector"))
    parts = parts_of(lines)
    met = dealt(orders, parts, "o_orderkey").join(dealt(lines, parts, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("fiscal_year", F.year("o_orderdate"))
    sums = met.groupBy("ticker", "fiscal_year").agg(F.max("o_orderdate").cast("date").alias("period_end_date"), *[F.round(F.sum(F.expr(e)), d).alias(n) for n, (e, d) in MEASURES.items()])
    rows = sums.join(customers, "ticker")
    return rows.select(
        "*", (F.col("net_income") / F.col("shares")).alias("eps"), (F.col("operating_cash_flow") - F.col("capex")).alias("free_cash_flow"),
        F.when(F.col("revenue") != 0, F.col("operating_income") / F.col("revenue")).alias("operating_margin"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with segment and total spend, null without orders."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector"))
    total = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return customers.join(total, "ticker", "left")


SPEND_SQL = """
spend AS (
  SELECT c_custkey AS ticker, c_mktsegment AS sector, s.spend
  FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_custkey) s ON o_custkey = c_custkey)"""
