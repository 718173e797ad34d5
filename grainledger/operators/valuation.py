"""Valuations of a company: three discounted scenarios, cash-flow yield, EV to EBIT, and the range of past P/E."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.functions.measures import clamp, ev_to_ebit, fcf_yield, growth_rate, margin_of_safety, owner_earnings, price_to_earnings, two_stage_value
from grainledger.operators.series import as_of

#: The discount rate, terminal growth by scenario, spread and bounds of growth, years projected and read.
DISCOUNT = 0.095
SCENARIOS = {"bear": (-0.04, 0.015), "base": (0.0, 0.025), "bull": (0.04, 0.030)}
GROWTH_LOW, GROWTH_HIGH, YEARS, READ = -0.10, 0.20, 10, 10
FEW_MULTIPLES = 5


def scenario_growth(rate: Column, spread: float) -> Column:
    """An unknown rate counts as zero; it is bounded before and after the spread."""
    return clamp(clamp(F.coalesce(rate, F.lit(0.0)), GROWTH_LOW, GROWTH_HIGH) + spread, GROWTH_LOW, GROWTH_HIGH)


def _basis(panel_row_columns: tuple[str, ...] = ()) -> list[Column]:
    """Aggregates of a ticker's years: rate, base and the newest row's columns."""
    when = F.when(F.col("revenue") > 0, F.col("fiscal_year"))
    rate = growth_rate(F.min_by("revenue", when), F.min(when), F.max_by("revenue", when), F.max(when))
    earned = owner_earnings("net_income", "depreciation", "capex", "working_capital_change")
    years = F.slice(F.sort_array(F.collect_list(F.struct("fiscal_year", earned.alias("earned"))), asc=False), 1, READ)
    known = F.filter(F.transform(years, lambda y: y["earned"]), lambda e: e.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, e: a + e) / F.size(known))
    return [rate.alias("rate"), mean.alias("base"), *[F.max_by(c, "fiscal_year").alias(c) for c in panel_row_columns]]


def _scenarios() -> list[tuple[str, Column, Column]]:
    """(name, growth, value) from the columns rate and base."""
    out = []
    for name, (spread, terminal) in SCENARIOS.items():
        growth = scenario_growth(F.col("rate"), spread)
        out.append((name, growth, F.when(F.col("base").isNotNull(), two_stage_value("base", growth, DISCOUNT, terminal, YEARS))))
    return out


def scenario_values(panel: DataFrame) -> DataFrame:
    """ticker, scenario, growth, base and value from owner earnings of the last rows (columns as in the panel)."""
    rows = [F.struct(F.lit(n).alias("scenario"), g.alias("growth"), F.col("base").alias("base"), v.alias("value")) for n, g, v in _scenarios()]
    return panel.groupBy("ticker").agg(*_basis()).select("ticker", F.inline(F.array(*rows)))


def past_multiples(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """ticker, pe_low, pe_high, pe_years, low_confidence: price at each period's end over that year's earnings."""
    priced = as_of(panel.select("ticker", "period_end_date", "eps"), prices, "ticker", "period_end_date", "date", "close")
    pe = priced.withColumn("pe", price_to_earnings("close", "eps")).where("pe is not null")
    return pe.groupBy("ticker").agg(F.min("pe").alias("pe_low"), F.max("pe").alias("pe_high"), F.count("*").alias("pe_years")).withColumn("low_confidence", F.col("pe_years") < FEW_MULTIPLES)


def valuations(panel: DataFrame, prices: DataFrame, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(six rows for each company, errors). Rows: ticker, method, scenario, low, high, margin_of_safety, reason.

    A company without rows, prices or shares above zero is an error and has no rows. A method that can't be applied has
    a reason and no values. Panel and prices are laid in one order once, in so many ``parts``; a company is then one wide row, and its six
    rows come from that.
    """
    names = ("fiscal_year", "shares", "eps", "free_cash_flow", "total_debt", "cash", "operating_income")
    needed = {*names, "revenue", "net_income", "depreciation", "capex", "working_capital_change"}
    priced = as_of(panel.select("ticker", "period_end_date", *sorted(needed)), prices, "ticker", "period_end_date", "date", "close", parts)
    pe = price_to_earnings("close", "eps")
    wide = priced.groupBy("ticker").agg(*_basis(names), F.min(pe).alias("pe_low"), F.max(pe).alias("pe_high"))
    price = prices.where("close is not null").groupBy("ticker").agg(F.max_by("close", F.struct("date", "close")).alias("price"))
    all_ = wide.join(price, "ticker", "full_outer").withColumn("market_cap", F.col("price") * F.col("shares"))
    error = F.when(F.col("fiscal_year").isNull(), "no fundamentals").when(F.col("price").isNull(), "no prices").when(~F.coalesce(F.col("shares") > 0, F.lit(False)), "no shares")
    all_ = all_.withColumn("error", error)

    def row(method: str, scenario: str | None, low: Column, high: Column, margin: Column, reason: str) -> Column:
        return F.struct(
            F.lit(method).alias("method"), F.lit(scenario).cast("string").alias("scenario"), low.cast("double").alias("low"), high.cast("double").alias("high"),
            margin.cast("double").alias("margin_of_safety"), F.when(low.isNull(), reason).alias("reason"),
        )

    none, rows = F.lit(None), []
    for name, _, value in _scenarios():
        each = value / F.col("shares")
        rows.append(row("dcf", name, each, each, margin_of_safety(each, "price"), "no owner earnings"))
    yield_ = fcf_yield("free_cash_flow", "market_cap")
    multiple = ev_to_ebit("market_cap", "total_debt", "cash", "operating_income")
    low, high = (F.when(F.col("eps") > 0, F.col(c) * F.col("eps")) for c in ("pe_low", "pe_high"))
    rows.append(row("fcf_yield", None, yield_, yield_, none, "no free cash flow"))
    rows.append(row("ev_to_ebit", None, multiple, multiple, none, "no debt figure or no positive EBIT"))
    rows.append(row("pe_range", None, low, high, margin_of_safety(low, "price"), "no past P/E or no positive earnings"))
    return all_.where("error is null").select("ticker", F.inline(F.array(*rows))), all_.where("error is not null").select("ticker", "error")


def value_class(bear: Column, base: Column, bull: Column, price: Column, scenarios: Column, tight: Column) -> tuple[Column, Column]:
    """(class, reason): cheap at or under the bear value, expensive at or over the bull value, fair between; or abstain."""
    reason = (
        F.when(scenarios == 0, "no scenarios").when(scenarios != 3, "not three scenarios").when(bear.isNull() | base.isNull() | bull.isNull(), "unknown value")
        .when(~tight, "low and high differ").when((bear <= 0) | (base <= 0) | (bull <= 0), "value not positive").when((bear >= base) | (base >= bull), "scenarios out of order")
        .when(price.isNull() | ~(price > 0), "no price")
    )
    return F.when(reason.isNotNull(), "abstain").when(price <= bear, "cheap").when(price >= bull, "expensive").otherwise("fair"), reason


def thin_history(panel: DataFrame, least: int = 3) -> DataFrame:
    """ticker, years of the companies with fewer years than that."""
    return panel.groupBy("ticker").agg(F.count_distinct("fiscal_year").alias("years")).where(F.col("years") < least)


def assumptions(**values: Column) -> Column:
    """What a value rests on, as JSON with the names in the order given; unknown ones are written as null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})
