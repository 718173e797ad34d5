"""Queries of the screen: percentiles, metrics, quality, panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.functions.measures import debt_to_fcf, first_usable, ratio, row_flags, tier_of, total_debt
from grainledger.operators import screen, series
from grainledger.plans.base import PANEL_SQL, SPEND_SQL, panel, spend
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PERCENTILE = """
WITH {spend}
SELECT ticker, sector, spend,
       CASE WHEN spend IS NOT NULL AND sector IS NOT NULL AND count(*) OVER (PARTITION BY sector, spend IS NOT NULL) >= 5
            THEN round(100 * cume_dist() OVER (PARTITION BY sector, spend IS NOT NULL ORDER BY spend {order}), 6) END AS percentile,
       spend > 1000000 AS floor_pass
FROM spend"""


@query("SELECT *, coalesce(floor_pass, FALSE) AND coalesce(percentile >= 66.666667, TRUE) AS overall_pass, CASE WHEN floor_pass IS NULL THEN 'unavailable' WHEN coalesce(floor_pass, FALSE) AND coalesce(percentile >= 66.666667, TRUE) THEN 'pass' ELSE 'fail' END AS status FROM (" + _PERCENTILE.format(spend=SPEND_SQL, order="ASC") + ")")
def sector_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: spend against its sector and a floor, in three states."""
    rows = spend(spark, sf_dir)
    rows = series.peer_percentiles(rows, ["sector"], "spend", "percentile").withColumn("percentile", F.round("percentile", 6)).withColumn("floor_pass", F.col("spend") > 1_000_000)
    rows = rows.withColumn("overall_pass", screen.combine(F.col("floor_pass"), F.col("percentile") >= 66.666667))
    return rows.withColumn("status", screen.status(F.col("floor_pass"), F.col("overall_pass")))


@query(_PERCENTILE.format(spend=SPEND_SQL, order="DESC"))
def sector_percentile_lower_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spend(spark, sf_dir)
    return series.peer_percentiles(rows, ["sector"], "spend", "percentile", False).withColumn("percentile", F.round("percentile", 6)).select("*", (F.col("spend") > 1_000_000).alias("floor_pass"))


@query("""
SELECT *, coalesce(floor_pass, FALSE) AND coalesce(percentile >= 66.666667, TRUE) AS overall_pass FROM (
SELECT s_suppkey AS ticker, n_name AS sector, s_acctbal AS value, s_acctbal > 0 AS floor_pass,
       CASE WHEN count(*) OVER (PARTITION BY n_name) >= 5 THEN round(100 * cume_dist() OVER (PARTITION BY n_name ORDER BY s_acctbal), 6) END AS percentile
FROM supplier JOIN nation ON n_nationkey = s_nationkey)""")
def peer_floor_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("sector"), F.col("s_acctbal").alias("value"), (F.col("s_acctbal") > 0).alias("floor_pass"))
    rows = series.peer_percentiles(rows, ["sector"], "value", "percentile").withColumn("percentile", F.round("percentile", 6))
    return rows.withColumn("overall_pass", screen.combine(F.col("floor_pass"), F.col("percentile") >= 66.666667))


@query(f"WITH {PANEL_SQL} SELECT ticker, fiscal_year, sector, period_end_date, revenue, net_income, total_debt, round(eps, 6) AS eps, round(free_cash_flow, 4) AS free_cash_flow, round(operating_margin, 8) AS operating_margin FROM panel")
def annual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("ticker", "fiscal_year", "sector", "period_end_date", "revenue", "net_income", "total_debt", F.round("eps", 6).alias("eps"), F.round("free_cash_flow", 4).alias("free_cash_flow"), F.round("operating_margin", 8).alias("operating_margin"))


def _screen_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumn("gross_margin", ratio(F.col("revenue") - F.col("capex"), "revenue"))
    rows = rows.withColumn("roic", ratio("operating_income", F.col("total_debt") + F.col("equity"))).withColumn("roe", ratio("net_income", "equity"))
    rows = rows.withColumn("sector", F.when(F.col("sector") == "BUILDING", "Financials").otherwise(F.col("sector")))
    rows = rows.withColumn("flags", row_flags("eps", "shares", "net_income", "operating_income", "revenue"))
    return rows.withColumn("split", F.col("ticker") % 3 == 0)


# Shares step by 1.4 or more only where a split is recorded (here for every third company); the product of the later
# steps is taken in the same order, from the last year down, by a recursive fold.
_SCORES = f"""
WITH RECURSIVE {PANEL_SQL},
base AS (
  SELECT ticker, fiscal_year, CASE WHEN sector = 'BUILDING' THEN 'Financials' ELSE sector END AS sector, revenue, free_cash_flow, total_debt AS debt, operating_margin,
         CASE WHEN revenue <> 0 THEN (revenue - capex) / revenue END AS gross_margin,
         CASE WHEN total_debt + equity <> 0 THEN operating_income / (total_debt + equity) END AS roic, CASE WHEN equity <> 0 THEN net_income / equity END AS roe,
         eps, shares, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS back
  FROM panel),
factor AS (
  SELECT ticker, fiscal_year, back, shares, CAST(1.0 AS DOUBLE) AS factor, fiscal_year AS y FROM base WHERE back = 1
  UNION ALL
  SELECT b.ticker, b.fiscal_year, b.back, b.shares,
         f.factor * CASE WHEN b.ticker % 3 = 0 AND (f.shares / b.shares >= 1.4 OR f.shares / b.shares <= 1 / CAST(1.4 AS DOUBLE)) THEN f.shares / b.shares ELSE CAST(1.0 AS DOUBLE) END, b.fiscal_year
  FROM factor f JOIN base b ON b.ticker = f.ticker AND b.back = f.back + 1),
adj AS (SELECT b.*, b.shares * f.factor AS s, b.eps / f.factor AS e FROM base b JOIN factor f USING (ticker, fiscal_year)),
ends AS (
  SELECT ticker, min(fiscal_year) AS y1, max(fiscal_year) AS y2, arg_min(e, fiscal_year) AS e1, arg_max(e, fiscal_year) AS e2, arg_min(s, fiscal_year) AS s1, arg_max(s, fiscal_year) AS s2,
         arg_min(revenue, fiscal_year) AS r1, arg_max(revenue, fiscal_year) AS r2, arg_min(gross_margin, fiscal_year) AS g1, arg_max(gross_margin, fiscal_year) AS g2 FROM adj GROUP BY ticker),
wide AS (
  SELECT a.ticker, a.sector, a.roic, a.roe, a.operating_margin, a.free_cash_flow / a.revenue AS fcf_margin,
         CASE WHEN a.debt <= 0 THEN 0.0 WHEN a.free_cash_flow > 0 THEN a.debt / a.free_cash_flow END AS debt_to_fcf,
         CASE WHEN y2 > y1 AND r1 > 0 AND r2 >= 0 THEN pow(r2 / r1, 1.0 / (y2 - y1)) - 1 END AS revenue_growth,
         CASE WHEN y2 > y1 AND s1 > 0 AND s2 >= 0 THEN pow(s2 / s1, 1.0 / (y2 - y1)) - 1 END AS dilution,
         a.gross_margin, g2 - g1 AS change, e1, e2, a.debt, a.free_cash_flow AS fcf
  FROM adj a JOIN ends USING (ticker) WHERE a.back = 1),
long AS (
  SELECT ticker, sector, e1, e2, debt, fcf, change, m.metric, CASE m.metric WHEN 'roic' THEN roic WHEN 'roe' THEN roe WHEN 'fcf_margin' THEN fcf_margin WHEN 'operating_margin' THEN operating_margin
         WHEN 'revenue_growth' THEN revenue_growth WHEN 'debt_to_fcf' THEN debt_to_fcf WHEN 'dilution' THEN dilution ELSE gross_margin END AS value
  FROM wide CROSS JOIN (VALUES ('roic'), ('roe'), ('fcf_margin'), ('operating_margin'), ('revenue_growth'), ('debt_to_fcf'), ('dilution'), ('gross_margin')) m(metric)),
marked AS (SELECT *, sector = 'Financials' AND metric IN ('gross_margin', 'fcf_margin', 'debt_to_fcf') AS off FROM long),
ranked AS (
  SELECT *, round(CASE WHEN NOT off THEN CASE WHEN metric IN ('debt_to_fcf', 'dilution') THEN -value ELSE value END END, 9) AS signed FROM marked),
pct AS (
  SELECT *, CASE WHEN signed IS NOT NULL AND count(*) OVER (PARTITION BY metric, sector, signed IS NOT NULL) >= 5
                 THEN 100 * cume_dist() OVER (PARTITION BY metric, sector, signed IS NOT NULL ORDER BY signed) END AS percentile,
         CASE metric WHEN 'revenue_growth' THEN value > 0 AND coalesce(e2 >= e1, TRUE) WHEN 'debt_to_fcf' THEN CASE WHEN debt > 0 AND NOT coalesce(fcf > 0, FALSE) THEN FALSE ELSE value <= 5.0 END
              WHEN 'gross_margin' THEN change >= -0.005 WHEN 'dilution' THEN value <= 0.01 ELSE value > 0 END AS floor_pass
  FROM ranked),
passed AS (SELECT *, coalesce(floor_pass, FALSE) AND coalesce(percentile >= CAST(200 AS DOUBLE) / 3, TRUE) AS overall_pass FROM pct),
scores AS (
  SELECT ticker, sector, metric, round(value, 6) AS value, round(percentile, 6) AS percentile, floor_pass, overall_pass,
         CASE WHEN off THEN 'not_applicable' WHEN floor_pass IS NULL THEN 'unavailable' WHEN overall_pass THEN 'pass' ELSE 'fail' END AS status FROM passed)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.scores(screen.raw_metrics(_screen_input(spark, sf_dir)))


@query(_SCORES + "SELECT * FROM scores")
def metric_long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("value", F.round("value", 6)).withColumn("percentile", F.round("percentile", 6))


_QUALITY = ", quality AS (SELECT ticker, any_value(sector) AS sector, count(*) FILTER (WHERE status IN ('pass', 'fail')) AS assessed, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable FROM scores GROUP BY ticker)"


@query(_SCORES + _QUALITY + "SELECT ticker, assessed, passed, not_applicable, CASE WHEN assessed > 0 THEN round(100.0 * passed / assessed, 6) ELSE 0.0 END AS score, CASE WHEN assessed > 0 THEN 100.0 * passed / assessed >= 50 ELSE FALSE END AND assessed >= 6 AS passed_screen FROM quality")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.quality(_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_SCORES + _QUALITY + "SELECT coalesce(sector, '(no sector)') AS sector, count(*) AS companies, count(*) FILTER (WHERE assessed >= 6 AND 100.0 * passed / assessed >= 50) AS passing FROM quality GROUP BY 1")
def screen_pass_rate_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _scores(spark, sf_dir)
    sectors = long.groupBy("ticker").agg(F.first("sector").alias("sector"))
    return screen.quality(long).join(sectors, "ticker").groupBy(F.coalesce("sector", F.lit("(no sector)")).alias("sector")).agg(F.count("*").alias("companies"), F.count_if("passed_screen").alias("passing"))


@query("SELECT o_custkey AS ticker, o_orderkey, o_totalprice, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), "o_orderkey", "o_totalprice", "o_orderdate")
    return series.top_row(rows, ["ticker"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query(f"WITH {PANEL_SQL} SELECT ticker, min(fiscal_year) AS first_year, arg_min(equity, fiscal_year) AS first_value, max(fiscal_year) AS last_year, arg_max(equity, fiscal_year) AS last_value, count(*) AS points FROM panel WHERE equity IS NOT NULL GROUP BY ticker")
def first_last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.first_and_last(panel(spark, sf_dir), ["ticker"], "fiscal_year", "equity")


_CAGR = f"WITH {PANEL_SQL}, e AS (SELECT ticker, min(fiscal_year) AS y1, arg_min(net_income, fiscal_year) AS v1, max(fiscal_year) AS y2, arg_max(net_income, fiscal_year) AS v2 FROM panel {{where}} GROUP BY ticker) SELECT ticker, CASE WHEN y2 > y1 AND v1 > 0 AND v2 >= 0 THEN round(pow(v2 / v1, 1.0 / (y2 - y1)) - 1, 6) END AS growth FROM e"


@query(_CAGR.format(where="WHERE net_income IS NOT NULL"))
def revenue_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.growth(panel(spark, sf_dir), ["ticker"], "fiscal_year", "net_income").select("ticker", F.round("growth", 6).alias("growth"))


@query(_CAGR.format(where="WHERE net_income > 0"))
def strict_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.growth(panel(spark, sf_dir), ["ticker"], "fiscal_year", "net_income", strict=True).select("ticker", F.round("growth", 6).alias("growth"))


@query(_SCORES.split("ends AS (")[0].rstrip().rstrip(",") + " SELECT ticker, fiscal_year, round(s, 6) AS shares FROM adj")
def split_factor_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _screen_input(spark, sf_dir)
    splits = rows.where("split").select("ticker", "fiscal_year")
    f = series.split_factors(rows, ["ticker"], "fiscal_year", "shares", splits)
    met = rows.join(f, ["ticker", "fiscal_year"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return met.select("ticker", "fiscal_year", F.round(F.col("shares") * F.col("factor"), 6).alias("shares"))


_PRICES = "SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2"


@query(f"WITH prices AS ({_PRICES}), probes AS (SELECT l_partkey AS part, o_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS probe FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT p.part, o_orderkey, l_linenumber, probe, close FROM probes p ASOF LEFT JOIN prices r ON p.part = r.part AND p.probe >= r.date")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    prices = lines.select(F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("close"))
    probes = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("part"), "o_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("probe"))
    return series.as_of(probes, prices, "part", "probe", "date", "close")


_DAILY = "daily AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


@query(f"WITH {_DAILY}, met AS (SELECT a.ticker, a.date, b.value, abs(date_diff('day', b.date, a.date) - 365) AS gap, b.date AS other FROM daily a JOIN daily b ON a.ticker = b.ticker AND date_diff('day', b.date, a.date) BETWEEN 330 AND 400) SELECT d.ticker, d.date, d.value, m.value AS opening FROM daily d LEFT JOIN (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY gap, other, value) = 1) m ON m.ticker = d.ticker AND m.date = d.date")
def opening_balance_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("value"))
    return series.opening_value(daily, ["ticker"], "date", "value").select("ticker", "date", "value", "opening")


@query("SELECT o_custkey AS ticker, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def trailing_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), "o_orderkey", "o_orderdate")
    return series.last_rows(rows, ["ticker"], 10, F.desc("o_orderdate"), F.desc("o_orderkey"))




def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the greatest value of each event type, less 40 so that some are negative."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(*[F.max(F.when(F.col("event_type") == t, F.col("value") - 40)).alias(t) for t in TYPES])


TYPES = ("click", "purchase", "error", "signup", "view")
_TAGS_SQL = "tags AS (SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value - 40 END) AS {t}" for t in TYPES) + " FROM events GROUP BY 1, 2)"


@query(f"WITH {_TAGS_SQL} SELECT user_id, day, coalesce(click, purchase, error, signup, view) AS v, CASE WHEN click IS NOT NULL THEN 'click' WHEN purchase IS NOT NULL THEN 'purchase' WHEN error IS NOT NULL THEN 'error' WHEN signup IS NOT NULL THEN 'signup' WHEN view IS NOT NULL THEN 'view' END AS tag FROM tags")
def tag_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir)
    return rows.select("user_id", "day", F.coalesce(*TYPES).alias("v"), tier_of(**{t: F.col(t) for t in TYPES}).alias("tag"))


_KINDS = {f"{t}_{h}": f"{f}(CASE WHEN event_type = '{t}' THEN value - {d} END)" for t in TYPES for h, f, d in (("hi", "max", 40), ("lo", "min", 20))}
_KINDS_SQL = "kinds AS (SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"CASE WHEN {e} >= 0 THEN {e} END AS {n}" for n, e in _KINDS.items()) + " FROM events GROUP BY 1, 2)"


@query(f"""WITH {_KINDS_SQL},
t AS (SELECT user_id, day, coalesce(purchase_lo, error_lo) AS short, click_hi, click_lo, purchase_hi, coalesce(error_hi, CASE WHEN signup_hi IS NOT NULL OR signup_lo IS NOT NULL THEN coalesce(signup_hi, 0) + coalesce(signup_lo, 0) END) AS leases, view_hi AS notes, CASE WHEN view_lo IS NOT NULL OR error_lo IS NOT NULL THEN coalesce(view_lo, 0) + coalesce(error_lo, 0) END AS convertible FROM kinds),
f AS (SELECT *, greatest(click_hi, click_lo, purchase_hi + coalesce(short, 0)) AS free, greatest(notes, convertible) AS other FROM t)
SELECT user_id, day, round(coalesce(free, leases, other, short), 6) AS debt, CASE WHEN free IS NOT NULL THEN NULL WHEN leases IS NOT NULL THEN 'debt_includes_finance_leases' WHEN other IS NOT NULL THEN 'debt_from_instrument_tag' WHEN short IS NOT NULL THEN 'debt_current_portion_only' END AS flag FROM f""")
def debt_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest and least value of each event type stand for the ten figures."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(*[F.expr(e).alias(n) for n, e in _KINDS.items()])
    debt, flag = total_debt(["click_hi", "click_lo"], "purchase_hi", ["purchase_lo", "error_lo"], "error_hi", "signup_hi", "signup_lo", "view_hi", ["view_lo", "error_lo"])
    return rows.select("user_id", "day", F.round(debt, 6).alias("debt"), flag.alias("flag"))


@query(f"WITH {_TAGS_SQL} SELECT user_id, day, round(CASE WHEN click >= 0 THEN click WHEN purchase >= 0 THEN purchase WHEN error >= 0 THEN error + CASE WHEN signup >= 0 THEN signup ELSE 0 END WHEN view >= 0 THEN view END, 6) AS depreciation FROM tags")
def da_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainledger.functions.measures import depreciation

    value, _ = depreciation("click", "purchase", "error", "signup", "view")
    return _tags(spark, sf_dir).select("user_id", "day", F.round(value, 6).alias("depreciation"))


@query("""
SELECT l_orderkey, l_linenumber, nullif(concat_ws(',', CASE WHEN slip THEN 'share_count_unit_outlier' END, CASE WHEN NOT slip AND NOT (fit > 0.5 AND fit < 2.0) THEN 'eps_share_mismatch' END,
       CASE WHEN revenue > 0 AND (net > revenue OR operating > revenue) THEN 'implausible_ratio' END), '') AS flags
FROM (SELECT *, coalesce(fit > 0 AND (abs(fit - 1e3) / 1e3 <= 0.1 OR abs(1 / fit - 1e3) / 1e3 <= 0.1 OR abs(fit - 1e6) / 1e6 <= 0.1 OR abs(1 / fit - 1e6) / 1e6 <= 0.1 OR abs(fit - 1e9) / 1e9 <= 0.1 OR abs(1 / fit - 1e9) / 1e9 <= 0.1), FALSE) AS slip
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS net, p_retailprice * 30 AS revenue, l_extendedprice * (1 - l_discount) AS operating,
             CASE WHEN p_retailprice <> 0 AND l_quantity <> 0 AND l_extendedprice <> 0 THEN abs(p_retailprice * l_quantity / l_extendedprice) END AS fit
      FROM lineitem JOIN part ON p_partkey = l_partkey))""")
def ratio_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    found = row_flags("p_retailprice", "l_quantity", "l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("p_retailprice") * 30)
    return rows.select("l_orderkey", "l_linenumber", F.nullif(F.array_join(found, ","), F.lit("")).alias("flags"))


@query(f"WITH {PANEL_SQL} SELECT ticker, fiscal_year, CASE WHEN total_debt <= 0 THEN 0.0 WHEN free_cash_flow > 0 THEN round(total_debt / free_cash_flow, 6) END AS debt_to_fcf, CASE WHEN greatest(depreciation, working_capital_change) >= 0 THEN greatest(depreciation, working_capital_change) END AS usable FROM panel")
def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("ticker", "fiscal_year", F.round(debt_to_fcf("total_debt", "free_cash_flow"), 6).alias("debt_to_fcf"), first_usable(F.greatest("depreciation", "working_capital_change")).alias("usable"))
