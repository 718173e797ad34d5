"""Row-level measures as columns. Unknown stays null: nothing is filled with zero but where a docstring says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the measures.
TAX_RATE = 0.21
SPLIT_STEP = 1.4
UNIT_STEPS = (1e3, 1e6, 1e9)
UNIT_TOLERANCE, CORRECTION_TOLERANCE = 0.10, 0.02


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(top, bottom) -> Column:
    """top / bottom; null where the bottom is null or zero."""
    return F.when(_c(bottom) != 0, _c(top) / _c(bottom))


def positive_ratio(top, bottom) -> Column:
    """top / bottom; null unless the bottom is above zero."""
    return F.when(_c(bottom) > 0, _c(top) / _c(bottom))


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def is_close(a, b, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def flags(**found: Column) -> Column:
    """Names of the conditions that hold, in the order given; an unknown condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in found.items()]))


def free_cash_flow(ocf, capex) -> Column:
    """Both are needed: operating cash flow alone isn't free cash flow."""
    return _c(ocf) - _c(capex)


def gross_margin(gross_profit, revenue, cost) -> Column:
    return F.coalesce(ratio(gross_profit, revenue), ratio(_c(revenue) - _c(cost), revenue))


def roic(operating_income, debt, equity, cash) -> Column:
    """After-tax operating income on invested capital. Only cash may be missing, and counts as zero then."""
    return positive_ratio(_c(operating_income) * (1 - TAX_RATE), _c(debt) + _c(equity) - F.coalesce(_c(cash), F.lit(0.0)))


def roe(net_income, opening_equity, closing_equity) -> Column:
    """On mean equity, which must be known at both ends and not zero; it may be negative."""
    return ratio(net_income, (_c(opening_equity) + _c(closing_equity)) / 2)


def debt_to_fcf(debt, fcf) -> Column:
    """0 without debt; null where the free cash flow isn't above zero."""
    return F.when(_c(debt) <= 0, F.lit(0.0)).when(_c(fcf) > 0, _c(debt) / _c(fcf))


def owner_earnings(net_income, depreciation, capex, working_capital_change) -> Column:
    """The first three are needed; an unknown change of working capital counts as zero."""
    return _c(net_income) + _c(depreciation) - _c(capex) - F.coalesce(_c(working_capital_change), F.lit(0.0))


def margin_of_safety(low_value, price) -> Column:
    """Discount of the price to the low value; negative where the price is above it, null unless that value is."""
    return positive_ratio(_c(low_value) - _c(price), low_value)


def fcf_yield(fcf, market_cap) -> Column:
    return positive_ratio(fcf, market_cap)


def ev_to_ebit(market_cap, debt, cash, ebit) -> Column:
    """Debt is needed; unknown cash counts as zero; market value and EBIT must be above zero."""
    return F.when((_c(market_cap) > 0) & (_c(ebit) > 0), (_c(market_cap) + _c(debt) - F.coalesce(_c(cash), F.lit(0.0))) / _c(ebit))


def price_to_earnings(price, eps) -> Column:
    return positive_ratio(price, eps)


def two_stage_value(base, growth, discount, terminal_growth, years: int = 10) -> Column:
    """Present value of ``years`` of growing earnings and of what follows them; an error if that doesn't converge."""
    growth, discount, terminal_growth = _c(growth), _c(discount), _c(terminal_growth)
    start = F.struct(_c(base).cast("double").alias("earnings"), F.lit(0.0).alias("value"), F.lit(1.0).alias("factor"))

    def year(acc: Column, _: Column) -> Column:
        earnings, factor = acc["earnings"] * (1 + growth), acc["factor"] * (1 + discount)
        return F.struct(earnings.alias("earnings"), (acc["value"] + earnings / factor).alias("value"), factor.alias("factor"))

    def end(acc: Column) -> Column:
        return acc["value"] + acc["earnings"] * (1 + terminal_growth) / (discount - terminal_growth) / acc["factor"]

    value = F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, year, end)
    return F.when(terminal_growth >= discount, F.raise_error(F.lit("terminal growth must stay below the discount rate"))).otherwise(value)


def growth_rate(first, first_year, last, last_year) -> Column:
    """Compound yearly growth. Null with fewer than two years, a first value not above zero or a last one below it."""
    years = _c(last_year) - _c(first_year)
    return F.when((years > 0) & (_c(first) > 0) & (_c(last) >= 0), F.pow(_c(last) / _c(first), 1.0 / years) - 1)


def unit_slip(measure) -> Column:
    """Whether a ratio that should be 1 is within 10 % of a thousand, a million or a billion, or of one over them."""
    m = _c(measure)
    near = [F.abs(x - s) / s <= UNIT_TOLERANCE for s in UNIT_STEPS for x in (m, 1 / m)]
    return F.when(m > 0, reduce(Column.__or__, near)).otherwise(F.lit(False))


def row_flags(eps, shares, net_income, operating_income, revenue) -> Column:
    """Doubts about a row: shares that don't fit earnings per share, or income above revenue."""
    fit = F.when((_c(eps) != 0) & (_c(shares) != 0) & (_c(net_income) != 0), F.abs(_c(eps) * _c(shares) / _c(net_income)))
    slip = unit_slip(fit)
    above = lambda x: (_c(revenue) > 0) & (_c(x) > 0) & (_c(x) > _c(revenue))
    return flags(
        share_count_unit_outlier=slip,
        eps_share_mismatch=~slip & ~((fit > 0.5) & (fit < 2.0)),
        implausible_ratio=above(net_income) | above(operating_income),
    )


def basis_change(original, restated) -> Column:
    """``split``, ``unit_correction`` or null, for a count of shares that a later filing restates."""
    r = F.when((_c(original) > 0) & (_c(restated) != 0), _c(restated) / _c(original))
    unit = reduce(Column.__or__, [F.abs(x - s) / s <= CORRECTION_TOLERANCE for s in UNIT_STEPS for x in (r, 1 / r)])
    return F.when((r >= SPLIT_STEP) | (r <= 1 / SPLIT_STEP), F.when(unit, "unit_correction").otherwise("split"))


def symmetric_difference(x, y) -> Column:
    """2 |x - y| / (|x| + |y|), 0 for two zeros."""
    x, y = _c(x), _c(y)
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(2 * F.abs(x - y) / (F.abs(x) + F.abs(y)))


def weekdays_between(after, before) -> Column:
    """Mondays to Fridays strictly between two dates."""
    after, before = _c(after), _c(before)
    days = F.when(F.datediff(before, after) > 1, F.sequence(F.date_add(after, 1), F.date_sub(before, 1))).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def first_usable(*tiers: Column) -> Column:
    """The first of the tiers that is known and not negative."""
    return F.coalesce(*[F.when(t >= 0, t) for t in tiers])


def tier_of(**tiers: Column) -> Column:
    """The name of the first tier that is known."""
    return F.coalesce(*[F.when(t.isNotNull(), F.lit(n)) for n, t in tiers.items()])


def total_revenue(consolidated, contract, lease) -> Column:
    """A consolidated figure alone; else contract and lease income, of which one may be missing."""
    parts = F.coalesce(_c(contract), F.lit(0.0)) + F.coalesce(_c(lease), F.lit(0.0))
    return F.coalesce(_c(consolidated), F.when(_c(contract).isNotNull() | _c(lease).isNotNull(), parts))


def sum_known(*parts) -> Column:
    """Sum of the parts that are known; null if none is."""
    parts = [_c(x) for x in parts]
    known = reduce(Column.__or__, [x.isNotNull() for x in parts])
    return F.when(known, reduce(Column.__add__, [F.coalesce(x, F.lit(0.0)) for x in parts]))


def greatest_known(*parts) -> Column:
    return F.greatest(*map(_c, parts)) if len(parts) > 1 else _c(parts[0])


def total_debt(totals: list, noncurrent, current: list, leases, leases_noncurrent, leases_current, notes, convertibles: list) -> tuple[Column, Column]:
    """(debt, flag) by tiers; negative figures don't count.

    Free of leases: the largest of the totals and of non-current plus current debt, no flag. With leases: their total, or
    else the sum of its parts. Instruments: the larger of notes and the sum of convertibles. Last the current portion alone.
    """
    usable = lambda x: F.when(_c(x) >= 0, _c(x))
    short = F.coalesce(*map(usable, current))
    free = greatest_known(*map(usable, totals), usable(noncurrent) + F.coalesce(short, F.lit(0.0)))
    leased = F.coalesce(usable(leases), sum_known(usable(leases_noncurrent), usable(leases_current)))
    other = greatest_known(usable(notes), sum_known(*map(usable, convertibles)))
    flag = F.when(free.isNotNull(), F.lit(None).cast("string")).otherwise(tier_of(debt_includes_finance_leases=leased, debt_from_instrument_tag=other, debt_current_portion_only=short))
    return F.coalesce(free, leased, other, short), flag


def depreciation(combined, net_of_accretion, alone, amortisation, last_resort) -> tuple[Column, Column]:
    """(value, flags): combined, net of accretion, depreciation plus amortisation, last resort.

    A missing or negative amortisation counts as zero in the sum. Negative figures above the tier that is used are
    flagged, and a value under four fifths of the last resort.
    """
    a, b, d, m, z = (_c(x) for x in (combined, net_of_accretion, alone, amortisation, last_resort))
    parts = F.when(d >= 0, d + F.when(m >= 0, m).otherwise(0.0))
    value = first_usable(a, b, parts, z)
    above = F.coalesce(a < 0, F.lit(False)) | (~F.coalesce(a >= 0, F.lit(False)) & F.coalesce(b < 0, F.lit(False)))
    parted = ~F.coalesce(a >= 0, F.lit(False)) & ~F.coalesce(b >= 0, F.lit(False)) & parts.isNotNull()
    return value, flags(negative_skipped=above | (parted & (m < 0)), below_last_resort=value < 0.8 * z)


def capex(first, second, third, oil_gas, other) -> Column:
    """The first known of three; else oil and gas, which is needed, plus other property, which isn't."""
    return F.coalesce(_c(first), _c(second), _c(third), _c(oil_gas) + F.coalesce(_c(other), F.lit(0.0)))
