"""Operators on keyed series: latest rows, percentiles, growth, split adjustment, as-of and nearest look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions.measures import SPLIT_STEP, growth_rate
from grainledger.session import cut, dealt


def top_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order. Give a total order, else ties fall as they come."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_rows(df: DataFrame, keys: list[str], count: int, *order: Column) -> DataFrame:
    """The first ``count`` rows of each key in this order: rows, not calendar years."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= count).drop("_n")


#: Parts, of about equal numbers of different values, into which a group's values are laid for counting.
PARTS = 128


def value_counts(df: DataFrame, group: list[str], value: str, parts: int = PARTS, tally: Column | None = None) -> DataFrame:
    """group, value, n, upto and total of each different value: its rows, those with at most this value, and all of its group.

    With ``tally``, a condition, also tally_upto: how many of the rows up to this value fulfil it.

    A group may hold any share of the rows: its values are parted at approximate quantiles, counted up inside a part, on top of the parts before.
    So no task orders a whole group. Rows with a null value are left out; null keys of a group are one.
    """
    g = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))] or ["_g"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*(g or [F.lit(0).alias("_g")]), F.col(value).alias("_v")).agg(F.count("*").alias("n"), F.count_if(tally if tally is not None else F.lit(False)).alias("t"))
    counts = cut(counts)  # read three times
    edges = counts.groupBy(*keys).agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 20 * parts).alias("_edges"), F.sum("n").alias("total"))
    edges = cut(edges.select(*[F.col(k).alias(f"{k}e") for k in keys], F.array_distinct("_edges").alias("_edges"), "total"))  # read twice, and another run may part the values elsewhere
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}e")) for k in keys])
    laid = counts.join(edges, same).withColumn("_p", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    inside = W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    sums = laid.groupBy(*keys, "_p").agg(F.sum("n").alias("_n"), F.sum("t").alias("_t"))
    before = lambda c: F.coalesce(F.sum(c).over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("_p").alias("_q"), before("_n").alias("_n_before"), before("_t").alias("_t_before"))
    met = laid.withColumn("_n_inside", F.sum("n").over(inside)).withColumn("_t_inside", F.sum("t").over(inside)).join(sums, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys]) & (F.col("_p") == F.col("_q")))
    return met.select(*[F.col(k).alias(c) for k, c in zip(keys, group)], F.col("_v").alias(value), "n", (F.col("_n_inside") + F.col("_n_before")).alias("upto"), "total", *([] if tally is None else [(F.col("_t_inside") + F.col("_t_before")).alias("tally_upto")]))


def _by_value(df: DataFrame, group: list[str], value: str) -> DataFrame:
    counts = value_counts(df, group, value).select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col(value).alias("_of_value"), "n", "upto", "total")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], F.col(value) == F.col("_of_value"))
    return df.join(counts, same, "left").drop(*[f"_of_{c}" for c in group], "_of_value")


def peer_percentiles(df: DataFrame, group: list[str], value: str, name: str, higher_is_better: bool = True, least_peers: int = 5) -> DataFrame:
    """df with ``name``: the share, in percent, of the peers that a value is at least as good as; ties count in its favour.

    Null where the value or the group is null, or fewer than ``least_peers`` have one. df has no columns n, upto or total.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group], F.col(value).isNotNull())
    good = F.col("upto") if higher_is_better else F.col("total") - F.col("upto") + F.col("n")
    return _by_value(df, group, value).withColumn(name, F.when(known & (F.col("total") >= least_peers), 100 * (good / F.col("total")))).drop("n", "upto", "total")


def first_and_last(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """keys, first_year, first_value, last_year, last_value and points of the years with a value."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.min(year).alias("first_year"), F.min_by(value, year).alias("first_value"),
        F.max(year).alias("last_year"), F.max_by(value, year).alias("last_value"), F.count("*").alias("points"),
    )


def growth(df: DataFrame, keys: list[str], year: str, value: str, strict: bool = False) -> DataFrame:
    """first_and_last with ``growth``, the compound yearly rate; strict: only years above zero count."""
    ends = first_and_last(df.where(F.col(value) > 0) if strict else df, keys, year, value)
    return ends.withColumn("growth", growth_rate("first_value", "first_year", "last_value", "last_year"))


def split_factors(df: DataFrame, keys: list[str], year: str, shares: str, confirmed: DataFrame) -> DataFrame:
    """keys, year and ``factor``, by which a year's shares are multiplied to stand on the latest basis.

    A step between neighbouring years counts if it is at least 1.4 up or down and ``confirmed`` (keys, year) has a
    split in the later year. A year's factor is the product of the later steps. The product runs over one key's years
    as a fold, so that it multiplies in the same order everywhere.
    """
    positive = df.where(F.col(shares) > 0).select(*keys, F.col(year).alias("year"), F.col(shares).cast("double").alias("shares"))
    known = confirmed.select(*keys, F.col(year).alias("year"), F.lit(True).alias("confirmed")).distinct()
    series = positive.join(known, [*keys, "year"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", "shares", "confirmed")), asc=False).alias("years"))
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(None).cast("double").alias("later"), F.lit(False).alias("open"), F.array().cast("array<struct<year:int,factor:double>>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        step = acc["later"] / x["shares"]
        factor = acc["factor"] * F.when(acc["open"] & ((step >= SPLIT_STEP) | (step <= 1 / SPLIT_STEP)), step).otherwise(1.0)
        out = F.concat(acc["out"], F.array(F.struct(x["year"].cast("int").alias("year"), factor.alias("factor"))))
        return F.struct(factor.alias("factor"), x["shares"].alias("later"), F.coalesce(x["confirmed"], F.lit(False)).alias("open"), out.alias("out"))

    folded = series.select(*keys, F.aggregate("years", start, fold, lambda a: a["out"]).alias("out"))
    return folded.select(*keys, F.explode("out").alias("o")).select(*keys, F.col("o.year").alias(year), F.col("o.factor").alias("factor"))


def as_of(probes: DataFrame, prices: DataFrame, key: str, probe_date: str, price_date: str, value: str, parts: int = 1) -> DataFrame:
    """Each probe with the latest value on or before its date, null if there is none or the date is null.

    Probes and prices are laid in one order by key and date, and the last value is carried forward: one shuffle, and
    no pairs of rows are made. Of prices with one date the greatest counts. ``parts``: in how many, by key, they are laid.
    """
    names = [c for c in probes.columns if c != key]
    left = probes.select(key, F.col(probe_date).alias("_d"), F.lit(1).alias("_probe"), F.lit(None).cast(prices.schema[value].dataType).alias("_v"), F.struct(*names).alias("_row"))
    right = prices.groupBy(key, F.col(price_date).alias("_d")).agg(F.max(value).alias("_v")).select(key, "_d", F.lit(0).alias("_probe"), "_v", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(key).orderBy(F.col("_d").asc_nulls_first(), "_probe").rowsBetween(W.unboundedPreceding, 0)
    both = dealt(left.union(right.where(F.col("_d").isNotNull())), parts, key).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_probe = 1")
    return both.select(key, *[F.col(f"_row.{c}").alias(c) for c in names], F.col("_v").alias(value))


def opening_value(df: DataFrame, keys: list[str], date: str, value: str, low: int = 330, middle: int = 365, high: int = 400) -> DataFrame:
    """Each row with ``opening``: the value dated 330 to 400 days before, the one nearest to 365 days; then the earlier.

    The band is met by an equality join on months: a partner's month is 10 to 14 before, so five keys meet it.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    own = df.select(*keys, F.col(date).alias("_end"), F.explode(F.sequence(month(date) - 14, month(date) - 10)).alias("_month")).distinct()
    other = df.where(F.col(value).isNotNull()).select(*keys, F.col(date).alias("_start"), F.col(value).alias("_value"), month(date).alias("_month"))
    days = F.datediff("_end", "_start")
    met = own.join(other, [*keys, "_month"]).where(days.between(low, high))
    best = met.groupBy(*keys, "_end").agg(F.min_by("_value", F.struct(F.abs(days - middle), F.col("_start"), F.col("_value"))).alias("opening"))
    return df.join(best.withColumnRenamed("_end", date), [*keys, date], "left")


def running_prefix(df: DataFrame, keys: list[str], amount: str, cap: float, *order: Column) -> DataFrame:
    """Rows, in order within a key, until the amounts before them reach the cap: a prefix, nothing is skipped."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("spent_before", F.coalesce(F.sum(amount).over(w), F.lit(0.0))).where(F.col("spent_before") < cap)


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """df with ``name``: the rank from 1, ties share their mean rank; null for a null value. df has no columns n, upto or total."""
    return _by_value(df, group, value).withColumn(name, F.col("upto") - (F.col("n") - 1) / 2).drop("n", "upto", "total")
