"""A benchmark's exports: headings, grades, stars, bands and merges; and the figures of a company as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.functions.vectorised import vectorised
from grainledger.operators.upsert import latest_wins
from grainledger.sources.readers import strict_records

# Headings of an export with the fields that they name, the more special ones first, since a heading is matched by its beginning.
HEADINGS = {
    "Ticker": "ticker",
    "Name": "company_name",
    "Sector": "ms_sector",
    "Industry Group": "ms_industry_group",
    "Industry": "ms_industry",
    "Economic Moat": "economic_moat",
    "Moat Trend": "moat_trend",
    "Morningstar Rating": "star_rating",
    "Fair Value Uncertainty": "uncertainty",
    "Capital Allocation": "capital_allocation",
    "Fair Value": "fair_value",
    "Price/Fair Value": "price_fair_value",
    "Last Price": "last_price",
    "Market Cap": "market_cap",
    "1-Star Price": "one_star_price",
    "5-Star Price": "five_star_price",
    "Return on Invested Capital (Normalized)": "roic_normalized",
    "Return on Invested Capital": "roic",
    "Return on Equity (Normalized)": "roe_normalized",
    "Return on Equity (Forward)": "roe_forward",
    "Return on Equity": "roe",
    "Revenue": "revenue",
    "Gross Margin": "gross_margin",
    "Operating Margin": "operating_margin",
    "Net Income": "net_income",
    "EBITDA": "ebitda",
    "EBIT": "ebit",
    "Cash Flow from Operations": "operating_cash_flow",
    "Capital Expenditures": "capex",
    "Free Cash Flow": "free_cash_flow",
    "Total Debt": "total_debt",
    "Cash (Balance Sheet)": "cash_and_equiv",
    "Total Equity": "total_equity",
    "Working Capital": "working_capital",
    "Goodwill and Other Intangibles": "goodwill_and_intangibles",
    "Shares Outstanding": "shares_outstanding",
    "Enterprise Value": "enterprise_value",
    "Financial Health Grade": "financial_health_grade",
    "Profitability Grade": "profitability_grade",
    "Growth Grade": "growth_grade",
    "Analyst": "analyst",
    "Report Date": "report_date",
}
# Closed sets of a record's fields.
CLOSED = {"uncertainty": ("Low", "Medium", "High", "Very High", "Extreme"), "moat_trend": ("Positive", "Stable", "Negative"), "capital_allocation": ("Exemplary", "Standard", "Poor")}
GRADES, GRADE_STEP = {"F": 0.0, "D": 1.0, "C": 2.0, "B": 3.0, "A": 4.0}, 0.33
KEY = ("ticker", "stratum", "snapshot_date")


def benchmark_records(spark: SparkSession, path: str, required: list[str], optional: list[str], numbers: list[str], **closed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``strict_records`` of a benchmark: its closed sets (CLOSED and those given), a day of its snapshot, and ratings that can be read."""
    sets = {k: v for k, v in {**CLOSED, **closed}.items() if k in required + optional}
    return strict_records(spark, path, required, optional, numbers, sets, ("snapshot_date",), {"star_rating": lambda c: star_rating(c).isNotNull()} if "star_rating" in required + optional else None)


def field_of(heading: str | None) -> str | None:
    """The field that a heading names; null for an unknown one."""
    plain = " ".join((heading or "").split())
    return next((field for begin, field in HEADINGS.items() if plain.startswith(begin)), None)


def mapped(export: DataFrame) -> DataFrame:
    """The columns of an export whose headings are known, under their fields; of two with one field the first counts."""
    named: dict[str, str] = {}
    for c in export.columns:
        if (f := field_of(c)) and f not in named:
            named[f] = c
    return export.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f) for f, c in named.items()])


def grade_ordinal(grade: Column) -> Column:
    """F to A as 0 to 4, a third more or less for a sign; null for anything else."""
    g = F.upper(F.trim(grade))
    base = F.create_map(*[x for k, v in GRADES.items() for x in (F.lit(k), F.lit(v))])[F.substring(g, 1, 1)]
    return F.when(g.rlike(r"^[ABCDF][+-]?\z"), base + F.when(g.endswith("+"), GRADE_STEP).when(g.endswith("-"), -GRADE_STEP).otherwise(0.0))


def star_rating(value: Column) -> Column:
    """1 to 5 from a number, a text that begins with one, or a row of stars; null for anything else."""
    t = F.trim(F.regexp_replace(value.cast("string"), r"\s+", " "))
    first = F.substring_index(t, " ", 1)
    number = F.try_to_number(F.regexp_replace(first, r"^([1-5])(\.0+)?\z", "$1"), F.lit("9")).cast("int")
    spelt = F.when(first.rlike(r"^[1-5](\.0+)?\z"), number)
    glyphs = F.when(t.rlike("^[★☆]+\\z"), F.length(t) - F.length(F.replace(t, F.lit("★"), F.lit(""))))
    return F.coalesce(spelt, F.when(glyphs.between(1, 5), glyphs))


def bands(records: DataFrame) -> DataFrame:
    """Records with price_fair_value_calc, required_margin_of_safety_pct and band_width_x, from fair value, last price and the prices of one and five stars; null where one lacks or is 0."""
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    fair, last, five, one = (some(c) for c in ("fair_value", "last_price", "five_star_price", "one_star_price"))
    return records.select("*", F.round(last / fair, 6).alias("price_fair_value_calc"), F.round((1 - five / fair) * 100, 2).alias("required_margin_of_safety_pct"), F.round(one / five, 4).alias("band_width_x"))


def merged(stored: DataFrame, export: DataFrame) -> DataFrame:
    """Stored records with those of an export, which replace their own (KEY) and no others, sorted by stratum and ticker."""
    return latest_wins(stored, export, list(KEY)).orderBy("stratum", "ticker", "snapshot_date")


# figures as text


@vectorised("string")
def formatted(value: pd.Series, spec: pd.Series) -> pd.Series:
    """Numbers by a format such as ``+.1%`` or ``,.2f``: rounded as their binary value says, halves to even, which built-in formats don't do."""
    return pd.Series([None if v is None or v != v else format(v, f) for v, f in zip(value, spec)], dtype=object)


def percent(value: Column, digits: int = 1, signed: bool = False) -> Column:
    return formatted(value.cast("double"), F.lit(f"{'+' if signed else ''}.{digits}%"))


def money(value: Column) -> Column:
    """Dollars and cents with the thousands parted; the sign stands behind the dollar."""
    return F.concat(F.lit("$"), formatted(value.cast("double"), F.lit(",.2f")))


def times(value: Column) -> Column:
    return F.concat(formatted(value.cast("double"), F.lit(".1f")), F.lit("x"))


def quant_block(scores: DataFrame, quality: DataFrame) -> DataFrame:
    """ticker, block: a line for each metric in order of its name, and one for the score.

    Scores have ticker, sector, metric, value, percentile, status; quality ticker, score, passed, assessed. A metric that isn't assessed says why; one
    without a value says that there is no ratio to compare.
    """
    m, s = F.col("metric"), F.col("status")
    peers = F.coalesce(F.concat(F.lit(", "), formatted(F.col("percentile"), F.lit(".0f")), F.lit("th percentile in "), F.coalesce("sector", F.lit("(no sector)"))), F.lit(""))
    line = F.when(s.isin("unavailable", "not_applicable"), F.concat(m, F.lit(": "), s)).when(F.col("value").isNull(), F.concat(m, F.lit(": "), s, F.lit(" (no comparable ratio computed)"))).otherwise(F.concat(m, F.lit(": "), formatted(F.col("value"), F.lit(".4f")), F.lit(" ("), s, peers, F.lit(")")))
    lines = scores.groupBy("ticker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    total = F.concat(F.lit("composite_score: "), formatted(F.col("score"), F.lit(".1f")), F.format_string(" (%d/%d assessable metrics passed)", "passed", "assessed"))
    return lines.join(quality.select("ticker", total.alias("_total")), "ticker", "left").select("ticker", F.concat_ws("\n", "_lines", "_total").alias("block"))


def valuation_block(values: DataFrame) -> DataFrame:
    """ticker, block: price and the three values of each company with the margin against its price.

    ``values`` has ticker, scenario (bear, base, bull), value and price. Without a price there is no line for it, and margins are n/a.
    """
    order = F.array_position(F.array(F.lit("bear"), F.lit("base"), F.lit("bull")), F.col("scenario"))
    v, p = F.col("value"), F.col("price")
    margin = F.coalesce(percent(v / p - 1, signed=True), F.lit("n/a"))
    said = F.when(v.isNull(), F.lit("unavailable")).when(v <= 0, F.concat(money(v), F.lit(" — not investable on this basis"))).otherwise(F.concat(money(v), F.lit(" (margin of safety vs. current price: "), margin, F.lit(")")))
    line = F.struct(order.alias("o"), F.concat(F.lit("DCF "), F.col("scenario"), F.lit(": "), said).alias("line"))
    got = values.groupBy("ticker").agg(F.max("price").alias("price"), F.sort_array(F.collect_list(F.when(order > 0, line))).alias("l"))
    return got.select("ticker", F.concat_ws("\n", F.concat(F.lit("Current price: "), money(F.col("price"))), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("block"))
