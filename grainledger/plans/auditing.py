"""Queries of checks, comparisons, replays and admissible repeats over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions.measures import ratio
from grainledger.operators import auditing, comparing, valuation
from grainledger.plans.base import PANEL_SQL, panel
from grainledger.plans.screening import _SCORES, _scores
from grainledger.plans.valuing import _VALUES
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# chains of reuse

_COPIES = """
copies AS (
  SELECT o_orderkey AS run_id, o_custkey AS ticker, CASE WHEN o_orderkey % 13 = 5 THEN 'b' WHEN o_orderkey % 17 = 1 THEN NULL ELSE 'a' END AS cache_key,
         CASE WHEN o_custkey % 5 = 0 AND row_number() OVER w = 1 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) WHEN o_orderkey % 11 = 3 THEN NULL WHEN o_orderkey % 31 = 7 THEN -o_orderkey ELSE lag(o_orderkey) OVER w END AS reused_from_run_id
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


@query(f"""WITH RECURSIVE {_COPIES},
walk AS (
  SELECT run_id, ticker, cache_key, reused_from_run_id AS next, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS VARCHAR) AS code FROM copies
  UNION ALL
  SELECT w.run_id, w.ticker, w.cache_key, s.reused_from_run_id, list_append(w.seen, w.next),
         CASE WHEN list_contains(w.seen, w.next) THEN 'committee_reuse_cycle' WHEN s.run_id IS NULL THEN 'committee_reuse_source_missing' WHEN s.cache_key IS DISTINCT FROM w.cache_key THEN 'committee_cache_key_mismatch' END
  FROM walk w LEFT JOIN copies s ON s.run_id = w.next AND s.ticker = w.ticker WHERE w.next IS NOT NULL AND w.code IS NULL)
SELECT run_id, ticker, code FROM walk WHERE code IS NOT NULL""")
def reuse_chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as copies of their customer's order before; some start anew, some name a run that isn't there, some run in circles."""
    w = W.partitionBy("ticker").orderBy("run_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("ticker"))
    k = F.col("run_id")
    source = F.when((F.col("ticker") % 5 == 0) & (F.row_number().over(w) == 1), F.max("run_id").over(W.partitionBy("ticker"))).when(k % 11 == 3, F.lit(None)).when(k % 31 == 7, -k).otherwise(F.lag("run_id").over(w))
    return auditing.reuse_faults(o.select("run_id", "ticker", F.when(k % 13 == 5, "b").when(k % 17 == 1, F.lit(None)).otherwise("a").alias("cache_key"), source.alias("reused_from_run_id")))


@query("""WITH b AS (SELECT conv_id, CASE WHEN max(turn) >= 2 THEN sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) END AS bundle, sha256(min_by(text, turn)) AS old FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN bundle IS NULL THEN 'committee_cache_bundle_inputs_incomplete' ELSE 'committee_cache_bundle_mismatch' END AS code FROM b WHERE bundle IS NULL OR conv_id % 7 = 0""")
def bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of conversations; every seventh is that of an older state, and short conversations lack inputs."""
    c = table(spark, sf_dir, "conversations")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("said")))), lambda t: t["said"]), "\n")
    whole = c.groupBy("conv_id").agg(F.sha2(said, 256).alias("sha"), F.max("turn").alias("last"), F.sha2(F.min_by("text", "turn"), 256).alias("old"))
    bundles = whole.select("conv_id", F.when(F.col("last") >= 2, F.col("sha")).alias("bundle"))
    rows = whole.select("conv_id", F.when(F.col("conv_id") % 7 == 0, F.col("old")).otherwise(F.col("sha")).alias("cache_key"))
    return auditing.bundle_issues(rows, bundles, ["conv_id"])


@query(_SCORES + """, q AS (SELECT ticker, count(*) FILTER (WHERE status IN ('pass', 'fail')) + CASE WHEN ticker % 41 = 0 THEN 9 ELSE 0 END AS assessed, count(*) FILTER (WHERE status = 'pass') AS passed, CASE WHEN ticker % 29 = 0 THEN 2 ELSE 1 END AS screen FROM scores GROUP BY ticker)
SELECT 'quality_empty' AS rule, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM q UNION ALL SELECT 'quality_unknown_screen', count(*) FILTER (WHERE screen NOT IN (0, 1)) FROM q
UNION ALL SELECT 'quality_invalid_counts', count(*) FILTER (WHERE assessed > 8 OR passed > 8) FROM q UNION ALL SELECT 'quant_empty', CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM scores
UNION ALL SELECT 'quant_unknown_category', count(*) FILTER (WHERE ticker % 37 = 0) FROM scores UNION ALL SELECT 'valuation_empty', CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM scores UNION ALL SELECT 'valuation_unknown_shape', count(*) FILTER (WHERE metric = 'roe') FROM scores""")
def domain_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen's rows, some with values outside the closed sets."""
    long = _scores(spark, sf_dir)
    t = F.col("ticker")
    quality = long.groupBy("ticker").agg((F.count_if(F.col("status").isin("pass", "fail")) + F.when(t % 41 == 0, 9).otherwise(0)).alias("metrics_assessed"), F.count_if(F.col("status") == "pass").alias("metrics_passed")).withColumn("passed_screen", F.when(t % 29 == 0, 2).otherwise(1))
    quant = long.select("metric", F.when(t % 37 == 0, "maybe").otherwise(F.col("status")).alias("status"))
    values = long.select(F.lit("owner_earnings_dcf").alias("method"), F.when(F.col("metric") == "roe", "point").otherwise("base").alias("scenario"))
    return auditing.domain_issues(quality, quant, values)


# comparison with a benchmark

_LATEST = f"""{PANEL_SQL},
own AS (SELECT *, (revenue - capex) / revenue AS gross_margin, CASE WHEN total_debt + equity <> 0 THEN operating_income / (total_debt + equity) END AS roic, CASE WHEN equity <> 0 THEN net_income / equity END AS roe FROM panel),
lag_ AS (SELECT *, lag(equity) OVER w AS e0, lag(fiscal_year) OVER w AS y0, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS back FROM own WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)),
last AS (SELECT *, CASE WHEN y0 = fiscal_year - 1 AND (equity + e0) / 2 <> 0 THEN net_income / ((equity + e0) / 2) END AS mean_roe, CASE WHEN ticker % 4 = 0 THEN 'debt_includes_finance_leases' END AS flags, ticker % 5 - 2 AS d, period_end_date + CAST(ticker % 200 AS INTEGER) AS snapshot FROM lag_ WHERE back = 1),
who AS (SELECT c_custkey AS ticker, CASE WHEN c_nationkey % 9 = 0 THEN 'EUR' WHEN c_nationkey % 9 = 1 THEN NULL ELSE 'USD' END AS currency FROM customer)"""
_MONEY = {"revenue": "revenue", "net_income": "net_income", "operating_income": "operating_income", "operating_cash_flow": "operating_cash_flow", "capex": "capex", "free_cash_flow": "free_cash_flow", "total_debt": "total_debt", "cash_and_equiv": "cash", "total_equity": "equity"}
_SHARES = ("gross_margin", "operating_margin", "roic", "roe")


def _compared_sql() -> str:
    rows = [(f, f"abs((-{c} / 1000000.0 * (1 + d / 100.0)) * 1000000.0)" if f == "capex" else f"({c} / 1000000.0 * (1 + d / 100.0)) * 1000000.0", c, "1", "0") for f, c in _MONEY.items()]
    stated = "({c} * 100.0 + d * 0.7) / 100.0"
    rows += [(f, stated.format(c=f), f, "0", "1") for f in _SHARES]
    rows += [("shares_outstanding", "(shares / 1000000.0) * 1000000.0", "shares", "0", "0"), ("depreciation_amortization", "CAST(NULL AS DOUBLE)", "depreciation", "0", "0"), ("roe_average_equity_hypothesis", stated.format(c="roe"), "mean_roe", "0", "1")]
    x = lambda e: f"CASE WHEN ticker % 11 <> 0 THEN {e} END"
    rules = {"free_cash_flow": "'own_ocf_minus_capex_vs_benchmark_adjusted_fcf'", "total_debt": "CASE WHEN flags IS NULL THEN 'lease_treatment_not_reconciled' END", "operating_income": "'own_gaap_reported_vs_benchmark_adjusted'", "operating_margin": "'own_gaap_reported_vs_benchmark_adjusted'", "roe": "'baseline_ending_equity_vs_benchmark_average_equity'"}
    union = " UNION ALL ".join(f"SELECT ticker, '{f}' AS field, {x(e)} AS x, CAST({c} AS DOUBLE) AS y, {rules.get(f, 'CAST(NULL AS VARCHAR)')} AS definition, {m} = 1 AS monetary, {r} = 1 AS is_ratio, snapshot, period_end_date AS period FROM last" for f, e, c, m, r in rows)
    return f"""{_LATEST}, rows AS ({union}),
judged AS (SELECT r.*, x IS NULL OR y IS NULL AS unusable, monetary AND coalesce(currency <> 'USD', false) AS abroad, CASE WHEN is_ratio AND definition IS NULL THEN 0.0001 ELSE 1.0 END AS zero, (x = 0 AND y = 0) OR ((x > 0) = (y > 0)) AS same FROM rows r JOIN who USING (ticker)),
compared AS (SELECT ticker, field, x, y, CASE WHEN unusable THEN 'Unavailable' WHEN abroad THEN 'Inconclusive' WHEN definition IS NOT NULL THEN 'Definitional difference' WHEN is_ratio THEN CASE WHEN abs(x - y) <= 0.01 AND (same OR (abs(x) <= 0.0001 AND abs(y) <= 0.0001)) THEN 'Match' ELSE 'Probable defect' END ELSE 'Inconclusive' END AS outcome,
  CASE WHEN unusable THEN 'one_side_has_no_usable_value' WHEN abroad THEN 'currency_basis_ambiguous' WHEN definition IS NOT NULL THEN definition WHEN is_ratio THEN 'absolute_percentage_point_tolerance' ELSE 'ttm_vs_fiscal_year_without_exact_reconciliation' END AS rule,
  NOT unusable AND coalesce(period BETWEEN snapshot - INTERVAL 4 MONTH AND snapshot, false) AS near_period, CASE WHEN NOT unusable THEN abs(x - y) END AS absolute, CASE WHEN NOT unusable THEN same END AS same_sign,
  CASE WHEN NOT unusable AND NOT (abs(x) <= zero OR abs(y) <= zero) THEN 2 * abs(x - y) / (abs(x) + abs(y)) END AS relative, CASE WHEN NOT unusable AND x <> 0 AND y <> 0 THEN abs(log10(abs(x)) - log10(abs(y))) END AS magnitudes, CASE WHEN NOT unusable THEN abs(x) <= zero OR abs(y) <= zero END AS near_zero FROM judged)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumn("gross_margin", ratio(F.col("revenue") - F.col("capex"), "revenue"))
    rows = rows.withColumn("roic", ratio("operating_income", F.col("total_debt") + F.col("equity"))).withColumn("roe", ratio("net_income", "equity"))
    t = F.col("ticker")
    own = rows.select("ticker", "fiscal_year", "period_end_date", F.when(t % 4 == 0, comparing.LEASES).alias("quality_flags"), *[F.col(c).alias(comparing.MONETARY[f]) for f, c in _MONEY.items()], *_SHARES, F.col("shares").alias("shares_diluted"), F.col("depreciation").alias("depreciation_amortization"))
    last = own.groupBy("ticker").agg(F.max_by(F.struct("*"), "fiscal_year").alias("r")).select("r.*")
    d = (t % 5 - 2).cast("double")
    known = lambda e: F.when(t % 11 != 0, e)
    sign = {"capex": -1.0}
    stated = [known(F.lit(sign.get(f, 1.0)) * F.col(comparing.MONETARY[f]) / 1000000.0 * (1 + d / 100.0)).alias(comparing.STATED_AS.get(f, f)) for f in _MONEY] + [known(F.col(f) * 100.0 + d * 0.7).alias(f) for f in _SHARES]
    benchmark = last.select("ticker", F.date_add("period_end_date", (t % 200).cast("int")).alias("snapshot_date"), *stated, known(F.col("shares_diluted") / 1000000.0).alias("shares_outstanding"))
    currency = F.when(F.col("c_nationkey") % 9 == 0, "EUR").when(F.col("c_nationkey") % 9 == 1, F.lit(None)).otherwise("USD")
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), currency.alias("currency"))
    return comparing.field_comparisons(benchmark, own, companies, ending_equity=True)


_ROUND = {"benchmark_value": 6, "own_value": 6, "absolute": 6, "relative": 9, "magnitudes": 9}


@query(f"WITH {_compared_sql()} SELECT ticker, field, round(x, 6) AS benchmark_value, round(y, 6) AS own_value, outcome, rule, near_period, round(absolute, 6) AS absolute, same_sign, round(relative, 9) AS relative, round(magnitudes, 9) AS magnitudes, near_zero FROM compared")
def field_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel against a benchmark that states it in millions and percent, a few points off."""
    got = _compared(spark, sf_dir)
    return got.select(*[F.round(c, _ROUND[c]).alias(c) if c in _ROUND else c for c in got.columns])


@query(f"WITH {_compared_sql()}, f AS (SELECT DISTINCT field FROM rows), o(outcome) AS (VALUES {', '.join(f'({chr(39)}{o}{chr(39)})' for o in comparing.OUTCOMES)}) SELECT f.field, o.outcome, count(c.ticker) AS n FROM f CROSS JOIN o LEFT JOIN compared c ON c.field = f.field AND c.outcome = o.outcome GROUP BY 1, 2")
def comparison_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparing.outcome_counts(_compared(spark, sf_dir))


@query(f"""WITH {_compared_sql()}, p AS (SELECT ticker, max(absolute) FILTER (WHERE field = 'roe') AS a, max(absolute) FILTER (WHERE field = 'roe_average_equity_hypothesis') AS b FROM compared WHERE field IN ('roe', 'roe_average_equity_hypothesis') GROUP BY 1),
m AS (SELECT count(*) FILTER (WHERE b < a) AS improved, count(*) FILTER (WHERE b > a) AS worsened, count(*) FILTER (WHERE a = b) AS unchanged, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unavailable FROM p),
t AS (SELECT count(*) AS comparisons, count(*) FILTER (WHERE outcome IN ('Match', 'Probable defect')) AS comparable, count(*) FILTER (WHERE outcome = 'Match') AS matches FROM compared)
SELECT comparisons, comparable, CAST(comparable AS DOUBLE) / comparisons AS coverage, CAST(matches AS DOUBLE) / comparable AS accuracy, improved, worsened, unchanged, unavailable FROM t, m""")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparing.comparison_summary(_compared(spark, sf_dir))


# replays of single fixes


@query(_SCORES + """, m AS (SELECT ticker, count(*) FILTER (WHERE status IN ('pass', 'fail')) AS a, count(*) FILTER (WHERE status = 'pass') AS p, count(*) FILTER (WHERE status = 'unavailable') AS u FROM scores GROUP BY ticker),
s AS (SELECT ticker, a, p, CASE WHEN a > 0 THEN 100.0 * p / a ELSE 0.0 END AS s0, a + u AS a2, p + u AS p2, CASE WHEN a + u > 0 THEN 100.0 * (p + u) / (a + u) ELSE 0.0 END AS s2, ticker % 17 = 3 AS forged, ticker % 23 = 4 AS loose FROM m)
SELECT 'fix' AS fix_id, ticker, 'screen' AS stage, CASE WHEN NOT (forged OR loose) THEN CAST(a AS INTEGER) END AS assessed_before, CASE WHEN NOT (forged OR loose) THEN s0 END AS score_before, CASE WHEN NOT (forged OR loose) THEN CAST(a2 AS INTEGER) END AS assessed_after,
  CASE WHEN NOT (forged OR loose) THEN s2 END AS score_after, CASE WHEN NOT (forged OR loose) THEN CASE WHEN a >= 6 AND s0 >= 50 THEN 'pass' ELSE 'fail' END || '_to_' || CASE WHEN a2 >= 6 AND s2 >= 50 THEN 'pass' ELSE 'fail' END END AS transition,
  CASE WHEN loose THEN 'not_held_constant' WHEN forged THEN 'before_is_not_frozen' END AS fault FROM s""")
def screen_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the screen would give if all that was unavailable passed; some records claim another state before, or don't hold the rest constant."""
    frozen = _scores(spark, sf_dir).groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("metric", "status"))).alias("metrics"))
    t, m = F.col("ticker"), F.col("metrics")
    forged = F.transform_values(m, lambda k, v: F.when(k == "roe", F.when(v == "pass", "fail").otherwise("pass")).otherwise(v))
    values = F.lit(None).cast("struct<bear:double,base:double,bull:double,price:double>")
    records = frozen.select("ticker", F.lit("fix").alias("fix_id"), F.lit("screen").alias("stage"), F.lit("trace").alias("evidence"), (t % 23 != 4).alias("held_constant"), F.when(t % 17 == 3, forged).otherwise(m).alias("before_metrics"), F.transform_values(m, lambda k, v: F.when(v == "unavailable", "pass").otherwise(v)).alias("after_metrics"), values.alias("before_values"), values.alias("after_values"))
    return auditing.replays(records, frozen, spark.createDataFrame([], "ticker long, values struct<bear:double,base:double,bull:double,price:double>"))


@query(_VALUES + """, x AS (SELECT ticker, max(round(value, 2)) FILTER (WHERE scenario = 'bear') AS bear, max(round(value, 2)) FILTER (WHERE scenario = 'base') AS base, max(round(value, 2)) FILTER (WHERE scenario = 'bull') AS bull FROM values_ GROUP BY 1),
p AS (SELECT x.*, c_acctbal AS price, c_acctbal * 400 AS price2 FROM x JOIN customer ON c_custkey = ticker),
r AS (SELECT *, bear IS NULL OR base IS NULL OR bull IS NULL OR bear <= 0 OR base <= 0 OR bull <= 0 OR bear >= base OR base >= bull AS bad FROM p)
SELECT 'price' AS fix_id, ticker, 'valuation' AS stage, CAST(NULL AS INTEGER) AS assessed_before, CAST(NULL AS DOUBLE) AS score_before, CAST(NULL AS INTEGER) AS assessed_after, CAST(NULL AS DOUBLE) AS score_after,
  CASE WHEN ticker % 19 <> 2 THEN CASE WHEN bad OR NOT price > 0 THEN 'abstain' WHEN price <= bear THEN 'cheap' WHEN price >= bull THEN 'expensive' ELSE 'fair' END || '_to_' || CASE WHEN bad OR NOT price2 > 0 THEN 'abstain' WHEN price2 <= bear THEN 'cheap' WHEN price2 >= bull THEN 'expensive' ELSE 'fair' END END AS transition,
  CASE WHEN ticker % 19 = 2 THEN 'before_is_not_frozen' END AS fault FROM r""")
def valuation_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another price alone would make of each valuation; some records claim another price before."""
    value = lambda s: F.max(F.when(F.col("scenario") == s, F.round("value", 2))).alias(s)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_acctbal").cast("double").alias("price"))
    known = valuation.scenario_values(panel(spark, sf_dir)).groupBy("ticker").agg(*[value(s) for s in ("bear", "base", "bull")]).join(c, "ticker")
    state = lambda price: F.struct("bear", "base", "bull", price.alias("price"))
    p, metrics = F.col("price"), F.lit(None).cast("map<string,string>")
    records = known.select("ticker", F.lit("price").alias("fix_id"), F.lit("valuation").alias("stage"), F.lit("trace").alias("evidence"), F.lit(True).alias("held_constant"), metrics.alias("before_metrics"), metrics.alias("after_metrics"), state(F.when(F.col("ticker") % 19 == 2, p + 1).otherwise(p)).alias("before_values"), state(p * 400).alias("after_values"))
    return auditing.replays(records, spark.createDataFrame([], "ticker long, metrics map<string,string>"), known.select("ticker", state(p).alias("values")))
