"""Comparison of recorded fundamentals with a benchmark's, field by field, under ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.operators.evaluation import average_equity_roe, comparison, ratio_outcome

# Fields of the benchmark with the column of the recorded rows; the unit in which the benchmark states them; names of
# outcomes and rules; months within which a period counts as near.
MONETARY = {"revenue": "revenue", "net_income": "net_income", "operating_income": "operating_income", "operating_cash_flow": "operating_cash_flow", "capex": "capex", "free_cash_flow": "free_cash_flow", "total_debt": "total_debt", "cash_and_equiv": "cash_and_equiv", "total_equity": "stockholders_equity"}
RATIOS = {"gross_margin": "gross_margin", "operating_margin": "operating_margin", "roic": "roic", "roe": "roe"}
OTHERS = {"shares_outstanding": "shares_diluted", "depreciation_amortization": "depreciation_amortization"}
STATED_AS = {"operating_income": "ebit"}
MILLION, NEAR_MONTHS, LEASES = 1_000_000.0, 4, "debt_includes_finance_leases"
HYPOTHESIS = "roe_average_equity_hypothesis"
MATCH, DEFECT, DEFINITIONAL, INCONCLUSIVE, UNAVAILABLE = "Match", "Probable defect", "Definitional difference", "Inconclusive", "Unavailable"
OUTCOMES = (MATCH, DEFECT, DEFINITIONAL, INCONCLUSIVE, UNAVAILABLE)
RULES = {
    "free_cash_flow": "own_ocf_minus_capex_vs_benchmark_adjusted_fcf",
    "total_debt": "lease_treatment_not_reconciled",
    "operating_income": "own_gaap_reported_vs_benchmark_adjusted",
    "operating_margin": "own_gaap_reported_vs_benchmark_adjusted",
    "roe": "baseline_ending_equity_vs_benchmark_average_equity",
}


def _stated(field: str) -> Column:
    """The benchmark's figure in own units; null for what isn't a finite number."""
    if field == "depreciation_amortization":
        return F.lit(None).cast("double")
    v = F.col(STATED_AS.get(field, "roe" if field == HYPOTHESIS else field)).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    if field in RATIOS or field == HYPOTHESIS:
        return v / 100.0
    return F.abs(v * MILLION) if field == "capex" else v * MILLION


def field_comparisons(benchmark: DataFrame, fundamentals: DataFrame, companies: DataFrame, ending_equity: bool) -> DataFrame:
    """A row for each benchmark company and field: ticker, field, benchmark_value, own_value, outcome, rule, near_period and diagnostics.

    Benchmark rows have ticker, snapshot_date, and figures in millions and percent; of fundamentals (ticker, fiscal_year, period_end_date, figures,
    quality_flags) the last year is compared; companies have ticker and currency. ``ending_equity``: the recorded return on equity is on
    the year's end. The last field is that return on the mean of two years' equity. Rules in order: no usable value on a side, another currency,
    a difference of definition, a ratio's tolerance of one point; amounts of different periods can't be reconciled.
    """
    own = {**MONETARY, **RATIOS, **OTHERS}
    last = fundamentals.groupBy("ticker").agg(F.max_by(F.struct("fiscal_year", "period_end_date", "quality_flags", *sorted(set(own.values()))), "fiscal_year").alias("own"))
    mean = average_equity_roe(fundamentals.select("ticker", "fiscal_year", "net_income", F.col("stockholders_equity").alias("equity")), ["ticker"]).select(F.col("ticker").alias("_t"), F.col("fiscal_year").alias("_y"), F.col("roe").alias("_mean"))
    met = benchmark.join(last, "ticker", "left").join(companies.select("ticker", "currency"), "ticker", "left")
    met = met.join(mean, (F.col("ticker") == F.col("_t")) & (F.col("own.fiscal_year") == F.col("_y")), "left")
    leases = F.coalesce(F.contains(F.col("own.quality_flags"), F.lit(LEASES)), F.lit(False))

    def row(field: str, value: Column) -> Column:
        rule = RULES.get(field) if field != "roe" or ending_equity else None
        definition = F.when(~leases, rule) if field == "total_debt" else F.lit(rule).cast("string")
        return F.struct(F.lit(field).alias("field"), _stated(field).alias("x"), value.cast("double").alias("y"), definition.alias("definition"), F.lit(field in MONETARY).alias("monetary"), F.lit(field in RATIOS or field == HYPOTHESIS).alias("is_ratio"))

    rows = F.array(*[row(f, F.col(f"own.{c}")) for f, c in own.items()], row(HYPOTHESIS, F.col("_mean")))
    long = met.select("ticker", "snapshot_date", F.col("own.period_end_date").alias("period"), "currency", F.inline(rows))
    x, y = F.col("x"), F.col("y")
    unusable, foreign = x.isNull() | y.isNull(), F.col("monetary") & F.coalesce(F.col("currency") != "USD", F.lit(False))
    ratio = F.when(ratio_outcome(x, y) == "match", MATCH).otherwise(DEFECT)
    outcome = F.when(unusable, UNAVAILABLE).when(foreign, INCONCLUSIVE).when(F.col("definition").isNotNull(), DEFINITIONAL).when(F.col("is_ratio"), ratio).otherwise(INCONCLUSIVE)
    rule = (
        F.when(unusable, "one_side_has_no_usable_value").when(foreign, "currency_basis_ambiguous").when(F.col("definition").isNotNull(), F.col("definition"))
        .when(F.col("is_ratio"), "absolute_percentage_point_tolerance").otherwise("ttm_vs_fiscal_year_without_exact_reconciliation")
    )
    judged_as_ratio = F.col("is_ratio") & F.col("definition").isNull()
    d, e = comparison(x, y, 0.0001), comparison(x, y, 1.0)
    diagnostics = [F.when(~unusable, F.when(judged_as_ratio, d[k]).otherwise(e[k])).alias(k) for k in d]
    near = ~unusable & F.coalesce(F.col("period").between(F.add_months("snapshot_date", -NEAR_MONTHS), F.col("snapshot_date")), F.lit(False))
    return long.select("ticker", "field", x.alias("benchmark_value"), y.alias("own_value"), outcome.alias("outcome"), rule.alias("rule"), near.alias("near_period"), *diagnostics)


def outcome_counts(compared: DataFrame) -> DataFrame:
    """field, outcome, n over the full grid of fields and outcomes."""
    spark = compared.sparkSession
    grid = spark.createDataFrame([(f, o) for f in (*MONETARY, *RATIOS, *OTHERS, HYPOTHESIS) for o in OUTCOMES], "field string, outcome string")
    return grid.join(compared.groupBy("field", "outcome").agg(F.count("*").alias("n")), ["field", "outcome"], "left").select("field", "outcome", F.coalesce("n", F.lit(0)).alias("n"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: comparisons, comparable (matches and defects), coverage, accuracy, and what the mean of equity does to the returns on it."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    total = compared.agg(F.count("*").alias("comparisons"), (is_(MATCH) + is_(DEFECT)).alias("comparable"), is_(MATCH).alias("matches"))
    difference = lambda f: F.max(F.when((F.col("field") == f) & (F.col("outcome") != UNAVAILABLE), F.col("absolute")))
    pairs = compared.where(F.col("field").isin("roe", HYPOTHESIS)).groupBy("ticker").agg(difference("roe").alias("a"), difference(HYPOTHESIS).alias("b"))
    moved = pairs.agg(*[F.count_if(c).alias(k) for k, c in {"improved": F.col("b") < F.col("a"), "worsened": F.col("b") > F.col("a"), "unchanged": F.col("a") == F.col("b"), "unavailable": F.col("a").isNull() | F.col("b").isNull()}.items()])
    return total.crossJoin(moved).select("comparisons", "comparable", F.try_divide("comparable", "comparisons").alias("coverage"), F.try_divide("matches", "comparable").alias("accuracy"), "improved", "worsened", "unchanged", "unavailable")  # one row each
