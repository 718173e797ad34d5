"""The quantitative screen: eight metrics a company, each passed, failed, unavailable or not applicable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.functions.measures import SPLIT_STEP, debt_to_fcf, growth_rate, ratio
from grainledger.operators.series import peer_percentiles
from grainledger.session import cut

#: Floors, and the percentile that a value must reach among its peers.
FLOORS = {
    "roic": 0.0,
    "roe": 0.0,
    "fcf_margin": 0.0,
    "revenue_growth": 0.0,
    "operating_margin": 0.0,
    "debt_to_fcf": 5.0,
    "dilution": 0.01,
    "gross_margin": -0.005,  # of its change
}
LOWER_IS_BETTER = ("debt_to_fcf", "dilution")
PEER_BAR = 200 / 3
LEAST_PEERS = 5
NOT_APPLICABLE = {"Financials": ("gross_margin", "fcf_margin", "debt_to_fcf")}
DOUBTFUL = ("implausible_ratio", "share_count_unit_outlier")
SCORE_BAR, LEAST_ASSESSED = 50.0, 6


def status(floor: Column, overall: Column) -> Column:
    """What the floor can't determine is unavailable, whether there is a value or not."""
    return F.when(floor.isNull(), "unavailable").when(overall, "pass").otherwise("fail")


def combine(floor: Column, relative: Column) -> Column:
    """Floor and peers, or the floor alone where there aren't enough peers; an undetermined floor isn't passed."""
    return F.coalesce(floor, F.lit(False)) & F.coalesce(relative, F.lit(True))


def raw_metrics(panel: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """One row for each ticker: sector, quarantined, the eight metrics, and what special floors need.

    ``panel`` has ticker, sector, fiscal_year, revenue, free_cash_flow, total_debt, operating_margin, gross_margin, roic,
    roe, eps, shares and flags (array), and ``split``, whether one is recorded in the year; or else ``splits`` has ticker
    and fiscal_year of those. Years with a doubtful flag are left out, and a ticker with one is quarantined. The panel is
    read once, and dealt by ticker once: a ticker's years meet in an array, where splits are folded in.
    """
    if splits is not None:
        panel = panel.join(splits.select("ticker", "fiscal_year", F.lit(True).alias("split")).distinct(), ["ticker", "fiscal_year"], "left")
    doubtful = F.coalesce(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in DOUBTFUL])), F.lit(False))
    names = ("fiscal_year", "revenue", "free_cash_flow", "total_debt", "operating_margin", "gross_margin", "roic", "roe", "eps", "split")
    row = F.struct(*names, F.col("shares").cast("double").alias("shares"))
    rows = panel.groupBy("ticker").agg(
        F.max_by("sector", "fiscal_year").alias("sector"), F.bool_or(doubtful).alias("quarantined"),
        F.sort_array(F.collect_list(F.when(~doubtful, row)), asc=False).alias("rows"),
    )
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(None).cast("double").alias("later"), F.lit(False).alias("open"), F.array().cast("array<double>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        known, step = x["shares"] > 0, acc["later"] / x["shares"]
        factor = acc["factor"] * F.when(known & acc["open"] & ((step >= SPLIT_STEP) | (step <= 1 / SPLIT_STEP)), step).otherwise(1.0)
        open_ = F.when(known, F.coalesce(x["split"], F.lit(False))).otherwise(acc["open"])
        return F.struct(factor.alias("factor"), F.when(known, x["shares"]).otherwise(acc["later"]).alias("later"), open_.alias("open"), F.concat(acc["out"], F.array(F.when(known, factor).otherwise(1.0))).alias("out"))

    rows = rows.withColumn("factors", F.aggregate("rows", start, fold, lambda acc: acc["out"]))
    years = rows.select("ticker", "sector", "quarantined", F.explode_outer(F.arrays_zip("rows", "factors")).alias("x")).select("ticker", "sector", "quarantined", "x.rows.*", F.col("x.factors").alias("factor"))
    years = years.withColumn("shares", F.col("shares") * F.col("factor")).withColumn("eps", F.col("eps") / F.col("factor"))
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("fiscal_year"))
    first, last = (lambda c: F.min_by(c, when(c))), (lambda c: F.max_by(c, when(c)))
    rate = lambda c: growth_rate(first(c), F.min(when(c)), last(c), F.max(when(c)))
    newest = lambda c: F.max_by(c, "fiscal_year")
    got = years.groupBy("ticker").agg(
        F.first("sector").alias("sector"), F.first("quarantined").alias("quarantined"),
        newest("roic").alias("roic"), newest("roe").alias("roe"), newest("operating_margin").alias("operating_margin"), newest("gross_margin").alias("gross_margin"),
        newest("revenue").alias("revenue"), newest("free_cash_flow").alias("fcf"), newest("total_debt").alias("debt"),
        rate("revenue").alias("revenue_growth"), rate("shares").alias("dilution"),
        first("eps").alias("first_eps"), last("eps").alias("last_eps"), (last("gross_margin") - first("gross_margin")).alias("margin_change"),
    )
    return got.select("*", ratio("fcf", "revenue").alias("fcf_margin"), debt_to_fcf("debt", "fcf").alias("debt_to_fcf"))


def floor_passed(metric: Column, value: Column) -> Column:
    """Null where it can't be told. Growth of revenue also needs the last earnings not below the first, if both are known;
    debt without cash flow fails outright; of the gross margin the change counts."""
    out = F.lit(None).cast("boolean")
    for name, bar in FLOORS.items():
        if name == "revenue_growth":
            passed = (value > bar) & F.coalesce(F.col("last_eps") >= F.col("first_eps"), F.lit(True))
        elif name == "debt_to_fcf":
            broke = (F.col("debt") > 0) & ~F.coalesce(F.col("fcf") > 0, F.lit(False))
            passed = F.when(broke, F.lit(False)).otherwise(value <= bar)
        elif name == "gross_margin":
            passed = F.col("margin_change") >= bar
        else:
            passed = value <= bar if name in LOWER_IS_BETTER else value > bar
        out = F.when(metric == name, passed).otherwise(out)
    return out


def scores(metrics: DataFrame) -> DataFrame:
    """Long: ticker, sector, metric, value, percentile, floor_pass, overall_pass, status; eight rows a ticker."""
    names = list(FLOORS)
    long = metrics.unpivot(["ticker", "sector", "quarantined", "first_eps", "last_eps", "debt", "fcf", "margin_change"], names, "metric", "value")
    off = F.lit(False)
    for sector, own in NOT_APPLICABLE.items():
        off = off | ((F.col("sector") == sector) & F.col("metric").isin(*own))
    off = F.coalesce(off, F.lit(False))
    long = long.withColumn("off", off).withColumn("peer_value", F.when(~F.col("quarantined") & ~F.col("off"), F.col("value")))
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.col("peer_value")).otherwise(F.col("peer_value"))
    long = long.withColumn("signed", F.round(signed, 9))  # values that differ by rounding alone are ties
    long = cut(long)  # a row a company and metric: the panel behind it is computed once, not for the counts and again for the rows
    long = peer_percentiles(long, ["metric", "sector"], "signed", "percentile", True, LEAST_PEERS)
    long = long.withColumn("floor_pass", floor_passed(F.col("metric"), F.col("value")))
    long = long.withColumn("overall_pass", combine(F.col("floor_pass"), F.col("percentile") >= F.lit(PEER_BAR)))
    state = F.when(F.col("quarantined"), "unavailable").when(F.col("off"), "not_applicable").otherwise(status(F.col("floor_pass"), F.col("overall_pass")))
    return long.select("ticker", "sector", "metric", "value", "percentile", "floor_pass", "overall_pass", state.alias("status"))


def quality(long: DataFrame) -> DataFrame:
    """ticker, assessed, passed, not_applicable, score and passed_screen; with nothing assessed the score is 0."""
    counted = long.groupBy("ticker").agg(
        F.count_if(F.col("status").isin("pass", "fail")).alias("assessed"), F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "not_applicable").alias("not_applicable"),
    )
    score = F.when(F.col("assessed") > 0, 100.0 * F.col("passed") / F.col("assessed")).otherwise(0.0)
    return counted.withColumn("score", score).withColumn("passed_screen", (F.col("score") >= SCORE_BAR) & (F.col("assessed") >= LEAST_ASSESSED))
