"""Names, identifiers, addresses and units of fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings of tickers. Fixed values.
ALIASES = {"BRK.B": "BRK-B", "BRK-B": "BRK-B", "BF.B": "BF-B", "BF-B": "BF-B"}
#: Fields that a benchmark states in millions. Fixed values.
MONETARY = ("revenue", "net_income", "operating_income", "operating_cash_flow", "capex", "free_cash_flow", "total_debt", "cash_and_equiv", "total_equity")
#: Width of the star band, and the uncertainty that it implies. Fixed values.
BAND_LADDER = {1.5625: "Low", 1.9286: "Medium", 2.5833: "High", 3.5: "Very High"}
_ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def ticker(raw: Column) -> Column:
    """Trimmed, in capitals, with a hyphen before a class of shares."""
    return F.replace(F.upper(F.trim(raw)), F.lit("."), F.lit("-"))


def canonical_ticker(raw: Column) -> Column:
    """A ticker in its one spelling; null where the text can't be one."""
    up = F.upper(F.trim(raw))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[up], up)
    return F.when(named.rlike("^[A-Z0-9][A-Z0-9.-]{0,14}$"), named)


def company_key(raw: Column) -> Column:
    """Ten digits with leading zeros, out of a text that may hold other signs; null without a digit."""
    digits = F.regexp_replace(raw.cast("string"), r"\D", "")
    return F.when(digits != "", F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits))


def filing_index_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(_ARCHIVE), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.htm"))


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit(_ARCHIVE), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def months_before(day: Column, months: int) -> Column:
    """The same day of an earlier month, or that month's last."""
    return F.add_months(day, -months)


def escaped_dollars(text: Column) -> Column:
    return F.replace(text, F.lit("$"), F.lit("\\$"))


def run_id(at: Column) -> Column:
    """A run's name from its start, a timestamp in UTC."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def snapshot_date(file_name: Column) -> Column:
    """The first of a file name's parts between underscores that is a date; null without one, never today."""
    parts = F.transform(F.split(F.regexp_replace(file_name, r"\.[^./]*$", ""), "_"), lambda p: F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(p)))
    return F.get(F.array_compact(parts), 0)


def benchmark_unit(field: Column, value: Column) -> Column:
    """A benchmark's figure in our units: millions to units, capital expenditure without its sign, percent to a fraction."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    scaled = F.when(field == "capex", F.abs(value * 1e6)).when(field.isin(*MONETARY, "shares_outstanding"), value * 1e6).otherwise(value / 100.0)
    return F.when(finite, scaled)


def coverage_tier(fair_value: Column, capital_allocation: Column) -> tuple[Column, Column]:
    """(tier, signals): a fair value with over two decimals, or no rating of capital allocation, is computed coverage."""
    unrounded = fair_value != F.round(fair_value, 2)
    signals = F.array_compact(F.array(F.when(unrounded, "unrounded_fair_value"), F.when(F.coalesce(capital_allocation, F.lit("")) == "", "no_capital_allocation")))
    return F.when(F.size(signals) > 0, "quantitative").otherwise("analyst"), signals


def band_uncertainty(width: Column) -> Column:
    """The step of the ladder within 0.02 of the width; ``OFF_LADDER`` for another, null for none."""
    out = F.when(width.isNull(), F.lit(None).cast("string"))
    for step, label in BAND_LADDER.items():
        out = out.when(F.abs(width - step) < 0.02, label)
    return out.otherwise("OFF_LADDER")


def price_measures(price: Column, fair: Column, five_star: Column, one_star: Column) -> dict[str, Column]:
    """Price to fair value, the margin of safety that five stars ask for in percent, and the band's width; null without both."""
    both = lambda a, b: (F.coalesce(a, F.lit(0.0)) != 0) & (F.coalesce(b, F.lit(0.0)) != 0)
    return {
        "price_fair_value": F.when(both(fair, price), F.round(price / fair, 6)),
        "required_margin_pct": F.when(both(fair, five_star), F.round((1 - five_star / fair) * 100, 2)),
        "band_width": F.when(both(five_star, one_star), F.round(one_star / five_star, 4)),
    }
