"""Statistics of an evaluation: contingency, agreement, ranks, intervals, counterfactuals and suppression."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions.measures import is_close, ratio, symmetric_difference
from grainledger.operators.series import average_ranks
from grainledger.operators.valuation import value_class

#: Cells below this stay hidden; weights of the six scores (risk counts inverted), bars of the status.
SMALL_CELL = 5
WEIGHTS = {
    "business": 0.25,
    "moat": 0.20,
    "strength": 0.15,
    "management": 0.10,
    "valuation": 0.25,
    "risk": 0.05,
}
#: The scores that each persona gives.
PERSONAS = {"quality": ("business", "moat", "management"), "valuation": ("strength", "valuation"), "bear": ("risk",)}
INVESTIGATE, WATCH = 70.0, 50.0
LEAST_ASSESSED, BOUNDARY, DEFINITIONAL = 6, 33.0, ("Financials", "Real Estate")
NEAR_ZERO, POINT = 0.0001, 0.01
REPLICATES, SEED, LEAST_ROWS, LEAST_STRATUM = 10_000, 61001, 20, 5
#: Different rows of a stratum that a task draws from.
PIECE = 4096


def rate(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def contingency(df: DataFrame, a: str, b: str, a_values: list, b_values: list) -> DataFrame:
    """Counts of all pairs of categories; pairs that don't occur stay as 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    return grid.join(df.groupBy(a, b).count().withColumnRenamed("count", "n"), [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def precision_and_lift(df: DataFrame, passed: Column, label: Column) -> DataFrame:
    """One row: counts, precision, recall, base rate, lift and the share of rows without a label; nulls for 0 / 0."""
    p, l_ = F.coalesce(passed, F.lit(False)), label
    counted = df.agg(F.count("*").alias("n"), F.count_if(p).alias("passed"), F.count_if(l_).alias("labelled_true"), F.count_if(l_.isNotNull()).alias("rated"), F.count_if(p & l_).alias("hits"), F.count_if(p & l_.isNotNull()).alias("passed_rated"))
    precision, base = rate(F.col("hits"), F.col("passed_rated")), rate(F.col("labelled_true"), F.col("rated"))
    return counted.select("n", "passed", "rated", "hits", precision.alias("precision"), rate(F.col("hits"), F.col("labelled_true")).alias("recall"), base.alias("base_rate"), F.try_divide(precision, base).alias("lift"), rate(F.col("n") - F.col("rated"), F.col("n")).alias("unrated_rate"))


def spearman(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """group, n and rho; null with fewer than two rows or where either side doesn't vary."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(known, x, group, "_x"), y, group, "_y")
    varied = (F.count("*") > 1) & (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.when(varied, F.corr("_x", "_y")).alias("rho"))


def transitions(before: DataFrame, after: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    """Counts of (from, to) over the full grid of states; keys on one side only are entrants or exits."""
    both = before.select(key, F.col(state).alias("_from")).join(after.select(key, F.col(state).alias("_to")), key, "full_outer")
    both = both.select(F.coalesce("_from", F.lit("absent")).alias("from_state"), F.coalesce("_to", F.lit("absent")).alias("to_state"))
    return contingency(both, "from_state", "to_state", [*states, "absent"], [*states, "absent"]).where("not (from_state = 'absent' and to_state = 'absent')")


def suppressed(counts: DataFrame, family: list[str], n: str) -> DataFrame:
    """Counts with ``shown``: null for a whole family as soon as one of its cells is below five.

    Families that share a total are one family, so that no hidden cell can be had by subtraction.
    """
    return counts.withColumn("shown", F.when(F.min(n).over(W.partitionBy(*family)) >= SMALL_CELL, F.col(n)))


def weighted(scores: dict[str, Column]) -> Column:
    """Sum of these scores by their weights, divided last; risk counts as 100 less itself.

    Weights are decimals: whole-numbered scores add up exactly, so that a score on a bar is on it; doubles add up as doubles.
    """
    terms = [F.lit(Decimal(str(WEIGHTS[k]))) * (100 - v if k == "risk" else v) for k, v in scores.items()]
    return reduce(Column.__add__, terms) / F.lit(float(sum(WEIGHTS[k] for k in scores)))


def overall_score(scores: dict[str, Column], without: tuple[str, ...] = (), replace: dict[str, Column] | None = None) -> Column:
    """Weighted score; a missing one is an error; without some the rest is renormalised."""
    used = {k: (replace or {}).get(k, scores[k]) for k in WEIGHTS if k not in without}
    return weighted({k: F.when(v.isNull(), F.raise_error(F.lit(f"score {k} is missing"))).otherwise(v) for k, v in used.items()})


def verdict_status(score: Column, severity: Column, capped: bool = True) -> Column:
    """Investigate, watch or reject; a severe bear case holds the first back, unless the cap is off."""
    known = F.when(~F.coalesce(severity.isin("low", "medium", "high"), F.lit(False)), F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(severity, F.lit("none")))))
    best = F.when((severity == "high") & F.lit(capped), "watch").otherwise("investigate")
    return F.coalesce(known.cast("string"), F.when(score >= INVESTIGATE, best).when(score >= WATCH, "watch").otherwise("reject"))


def counterfactuals(df: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """key, scenario, score, status; df has the six scores and the severity.

    Of each persona all scores are replaced at once: by the cohort's medians, by 50, by what contributes nothing (0, and
    100 for risk), or left out. Two scenarios of the bear case follow: its cap off, and its score and cap gone.
    """
    columns = {s: F.col(s) for s in WEIGHTS}
    medians = df.agg(*[F.median(s).alias(f"_{s}") for s in WEIGHTS])
    met = df.crossJoin(F.broadcast(medians))  # one row
    out = []

    def add(name: str, score: Column, capped: bool = True) -> None:
        out.append(F.struct(F.lit(name).alias("scenario"), score.alias("score"), verdict_status(score, F.col(severity), capped).alias("status")))

    add("as_is", overall_score(columns))
    for persona, own in PERSONAS.items():
        add(f"{persona}_median", overall_score(columns, replace={s: F.col(f"_{s}") for s in own}))
        add(f"{persona}_midpoint", overall_score(columns, replace={s: F.lit(50.0) for s in own}))
        add(f"{persona}_nothing", overall_score(columns, replace={s: F.lit(100.0 if s == "risk" else 0.0) for s in own}))
        add(f"{persona}_left_out", overall_score(columns, without=own))
    add("bear_cap_off", overall_score(columns), False)
    add("bear_gone", overall_score(columns, without=("risk",)), False)
    return met.select(key, F.inline(F.array(*out)))


def stratum(found: Column, passed: Column, assessed: Column, score: Column, sector: Column) -> Column:
    """What a run made of a company: abstain, pass, unassessable (by definition or for want of data), fail near the bar or
    clearly."""
    return (
        F.when(~F.coalesce(found, F.lit(False)), "abstain").when(passed, "pass")
        .when(F.coalesce(assessed, F.lit(0)) < LEAST_ASSESSED, F.when(sector.isin(*DEFINITIONAL), "unassessable-definitional").otherwise("unassessable-datagap"))
        .when(score >= BOUNDARY, "fail-boundary").otherwise("fail-clear")
    )


def external_support(moat: Column, value_class: Column, tier: Column) -> Column:
    """Support of a verdict by outside labels; quantitative coverage abstains first, a contradiction outweighs a gap."""
    moat, value_class, tier = (F.coalesce(x, F.lit("")) for x in (moat, value_class, tier))
    return (
        F.when(tier == "quantitative", "abstain").when((moat == "None") | (value_class == "expensive"), "contradicted")
        .when((moat == "") | value_class.isin("", "abstain"), "abstain").when((moat == "Wide") & (value_class == "cheap"), "strong")
        .when((moat == "Narrow") & (value_class == "cheap"), "weak").otherwise("ambiguous")
    )


def star_class(price: Column, five_star: Column, one_star: Column, fair: Column) -> tuple[Column, Column, Column]:
    """(class, rule, direction) of a price against the band of star prices; direction against the fair value itself."""
    good = lambda x: F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))
    rule = (
        F.when(~(good(price) & good(five_star) & good(one_star)), "unusable input").when(~(five_star < one_star), "band out of order")
        .when(price <= five_star, "at or below five stars").when(price > one_star, "above one star").otherwise("between")
    )
    cls = F.when(rule == "at or below five stars", "cheap").when(rule == "above one star", "expensive").when(rule == "between", "fair").otherwise("abstain")
    known = price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf")) & good(fair)
    return cls, rule, F.when(~F.coalesce(known, F.lit(False)), "unavailable").when(price <= fair, "at or below").otherwise("above")


def agreement(df: DataFrame, group: list[str]) -> DataFrame:
    """group, eligible, scored, coverage, exact, false_cheap, rho, direction of own_class against bench_class, and of
    own_direction against bench_direction; shares are null where there is nothing to divide by."""
    scored = (F.col("own_class") != "abstain") & (F.col("bench_class") != "abstain")
    pointed = scored & (F.col("own_direction") != "unavailable") & (F.col("bench_direction") != "unavailable")
    cheap = scored & (F.col("own_class") == "cheap")
    counts = df.groupBy(*group).agg(
        F.count("*").alias("eligible"), F.count_if(scored).alias("scored"), F.count_if(scored & (F.col("own_class") == F.col("bench_class"))).alias("_same"),
        F.count_if(cheap).alias("_cheap"), F.count_if(cheap & (F.col("bench_class") != "cheap")).alias("_false"),
        F.count_if(pointed).alias("_pointed"), F.count_if(pointed & (F.col("own_direction") == F.col("bench_direction"))).alias("_agree"),
    )
    # ranks of three classes follow from their counts
    place = lambda c: F.when(F.col(c) == "expensive", 0).when(F.col(c) == "fair", 1).otherwise(2)
    pairs = df.where(scored).groupBy(*group, place("own_class").alias("x"), place("bench_class").alias("y")).agg(F.count("*").alias("n"))
    mean_rank = lambda c: sum(F.when(F.col(c) > v, F.col(f"_{c}{v}")).otherwise(0) for v in range(2)) + F.element_at(F.array(*[F.col(f"_{c}{v}") for v in range(3)]), F.col(c) + 1) / 2.0
    sizes = pairs.groupBy(*group).agg(*[F.sum(F.when(F.col(c) == v, F.col("n")).otherwise(0)).alias(f"_{c}{v}") for c in "xy" for v in range(3)])
    ranked = pairs.join(sizes, group).select(*group, "n", mean_rank("x").alias("rx"), mean_rank("y").alias("ry"))
    s = lambda e: F.sum(F.col("n") * e)
    n, sx, sy = F.sum("n"), s(F.col("rx")), s(F.col("ry"))
    vx, vy = s(F.col("rx") * F.col("rx")) - sx * sx / n, s(F.col("ry") * F.col("ry")) - sy * sy / n
    rho = ranked.groupBy(*group).agg(F.when((n > 1) & (vx > 0) & (vy > 0), (s(F.col("rx") * F.col("ry")) - sx * sy / n) / F.sqrt(vx * vy)).alias("rho"))
    return counts.join(rho, group, "left").select(
        *group, "eligible", "scored", rate(F.col("scored"), F.col("eligible")).alias("coverage"), rate(F.col("_same"), F.col("scored")).alias("exact"),
        rate(F.col("_false"), F.col("_cheap")).alias("false_cheap"), "rho", rate(F.col("_agree"), F.col("_pointed")).alias("direction"),
    )


def comparison(x: Column, y: Column, near_zero: float) -> dict[str, Column]:
    """Diagnostics of two figures: difference relative (null near zero) and absolute, sign agreement, orders of magnitude."""
    near = (F.abs(x) <= near_zero) | (F.abs(y) <= near_zero)
    return {
        "relative": F.when(~near, symmetric_difference(x, y)),
        "absolute": F.abs(x - y),
        "same_sign": ((x == 0) & (y == 0)) | ((x > 0) == (y > 0)),
        "magnitudes": F.when((x != 0) & (y != 0), F.abs(F.log10(F.abs(x)) - F.log10(F.abs(y)))),
        "near_zero": near,
    }


def ratio_outcome(x: Column, y: Column) -> Column:
    """``match`` within a percentage point and of one sign (or both near zero), else ``probable defect``."""
    d = comparison(x, y, NEAR_ZERO)
    fine = (d["absolute"] <= POINT) & (d["same_sign"] | ((F.abs(x) <= NEAR_ZERO) & (F.abs(y) <= NEAR_ZERO)))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("string")).when(fine, "match").otherwise("probable defect")


def average_equity_roe(panel: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fiscal_year, roe of each year on the mean of its own and the year before's equity; null without that year."""
    w = W.partitionBy(*keys).orderBy("fiscal_year")
    before, year = F.lag("equity").over(w), F.lag("fiscal_year").over(w)
    mean = F.when(year == F.col("fiscal_year") - 1, (F.col("equity") + before) / 2)
    return panel.select(*keys, "fiscal_year", ratio("net_income", mean).alias("roe"))


def bootstrap(df: DataFrame, stratum: str, sums: dict[str, Column], metric: Callable[[dict[str, Column]], Column], replicates: int = REPLICATES, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """One row: n, estimate, low and high (2.5 and 97.5 %), replicates (those with a finite metric), method.

    The metric is a column over ``sums``, totals over the rows that a replicate draws (``{"v": F.col("x"), "n": F.lit(1)}`` and v / n for a
    mean). Strata keep their size; a null or empty one is Unknown. Those under five rows are pooled, or if the pool is under five, all
    rows are one stratum. Under twenty rows there is no interval. Null terms of a sum are 0.

    A stratum's different rows with their counts lie in pieces of about ``piece``, each drawn in its own task. How many
    of a replicate's draws fall to a piece is split along a binary tree over the pieces' sizes, with a generator for each node, so every
    task that passes a node sees the same split, and no task holds a stratum.
    """
    named = F.coalesce(F.when(F.col(stratum).cast("string") != "", F.col(stratum).cast("string")), F.lit("Unknown"))
    rows = df.select(named.alias("_s"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in sums.items()])
    sized = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    small = F.coalesce(F.sum(F.when(F.col("_n") < LEAST_STRATUM, F.col("_n"))), F.lit(0))
    method = F.when(small == 0, "sector_stratified").when(small >= LEAST_STRATUM, "sector_stratified_with_pooled_small_sectors").otherwise("unstratified_small_sector_fallback")
    how = sized.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), method.alias("method"))  # one row
    group = F.when(F.col("method").startswith("unstratified"), "all").when(F.col("_n") < LEAST_STRATUM, "pool").otherwise(F.concat(F.lit("s:"), F.col("_s")))
    groups = sized.crossJoin(F.broadcast(how.select("method"))).select("_s", group.alias("_g"))
    counts = rows.join(groups, "_s").groupBy("_g", *sums).agg(F.count("*").alias("_n"))
    pieces = counts.groupBy("_g").agg(F.ceil(F.count("*") / piece).alias("_k"))
    counts = counts.join(pieces, "_g").withColumn("_p", F.pmod(F.xxhash64(*sums), F.col("_k"))).drop("_k")
    sizes = counts.groupBy("_g", "_p").agg(F.sum("_n").alias("_n")).groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_p", "_n"))).alias("_l"))
    sizes = sizes.select("_g", F.transform("_l", lambda x: x["_n"]).alias("_sizes"), F.posexplode("_l").alias("_at", "_x")).select(F.col("_g").alias("_h"), F.col("_x._p").alias("_q"), "_at", "_sizes")
    names = list(sums)

    def draw(key: tuple, own: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        all_, at, mark = np.asarray(place["_sizes"][0], np.int64), int(place["_at"][0]), zlib.crc32(key[0].encode())
        low, high, n = 0, len(all_), np.full(replicates, all_.sum(), np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            first = np.random.default_rng([seed, mark, low, high]).binomial(n, all_[low:middle].sum() / all_[low:high].sum())
            low, high, n = (low, middle, first) if at < middle else (middle, high, n - first)
        own = own.sort_values(names)
        v, share = own[names].to_numpy(), own["_n"].to_numpy() / own["_n"].sum()
        rng, out = np.random.default_rng([seed, mark, at]), np.empty((replicates, len(names)))
        step = max(1, 2_000_000 // len(v))
        for r in range(0, replicates, step):
            out[r : r + step] = rng.multinomial(n[r : r + step], share) @ v
        return pd.DataFrame({"r": np.arange(replicates)} | {k: out[:, i] for i, k in enumerate(names)})

    kinds = ", ".join(f"`{k}` double" for k in names)
    drawn = counts.groupBy("_g", "_p").cogroup(sizes.groupBy("_h", "_q")).applyInPandas(draw, f"r int, {kinds}")
    value = metric({k: F.col(k) for k in names}).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    totals = drawn.groupBy("r").agg(*[F.sum(k).alias(k) for k in names]).select(F.when(finite, value).alias("m"))
    interval = totals.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("replicates"))
    estimate = rows.agg(*[F.sum(k).alias(k) for k in names]).select(value.alias("estimate"))
    enough = F.col("n") >= LEAST_ROWS
    met = how.crossJoin(estimate).crossJoin(interval)  # one row each
    return met.select("n", "estimate", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high", "replicates", "method")])


def bootstrap_interval(df: DataFrame, value: str, stratum: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The mean of ``value`` by ``bootstrap``, as n, mean, low, high and method; rows without a value don't count."""
    got = bootstrap(df.where(F.col(value).isNotNull()), stratum, {"total": F.col(value), "rows": F.lit(1)}, lambda t: F.try_divide(t["total"], t["rows"]), replicates, seed)
    return got.select("n", F.col("estimate").alias("mean"), "low", "high", "method")


def improvements(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """outcome and n of each way in which a difference moved; those that don't occur stay as 0."""
    b, a = F.col(before), F.col(after)
    moved = F.when(a.isNull() | b.isNull(), "unavailable").when(a < b, "improved").when(a > b, "worsened").otherwise("unchanged")
    counts = pairs.groupBy(moved.alias("outcome")).agg(F.count("*").alias("n"))
    grid = pairs.sparkSession.createDataFrame([(o,) for o in ("improved", "worsened", "unchanged", "unavailable")], "outcome string")
    return grid.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def price_views(scenarios: DataFrame, reference: DataFrame) -> DataFrame:
    """ticker, view, price, value_class, reason: each reference company (ticker, price) at the price of the run and at its own.

    Scenarios have ticker, scenario (bear, base, bull), low, high and current_price. A company whose scenarios name
    different prices abstains in the first view; the second doesn't look at them.
    """
    value = lambda s: F.max(F.when(F.col("scenario") == s, F.col("low"))).alias(s)
    wide = scenarios.groupBy("ticker").agg(
        *[value(s) for s in ("bear", "base", "bull")], F.count("*").alias("n"), F.min(F.col("low").eqNullSafe(F.col("high"))).alias("tight"),
        F.min("current_price").alias("p1"), F.max("current_price").alias("p2"),
    )
    all_ = reference.select("ticker", F.col("price").alias("other")).join(wide, "ticker", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    clash = F.coalesce(F.col("p1") != F.col("p2"), F.lit(False))
    view = lambda name, price: F.struct(F.lit(name).alias("view"), price.alias("price"))
    rows = all_.withColumn("v", F.explode(F.array(view("as_run", F.when(~clash, F.col("p1"))), view("price_normalised", F.col("other")))))
    cls, reason = value_class(F.col("bear"), F.col("base"), F.col("bull"), F.col("v.price"), F.col("n"), F.coalesce("tight", F.lit(True)))
    differing = clash & (F.col("v.view") == "as_run")
    return rows.select("ticker", "v.view", "v.price", F.when(differing, "abstain").otherwise(cls).alias("value_class"), F.when(differing, "prices differ").otherwise(reason).alias("reason"))


def linked_suppression(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """Counts with ``shown`` and ``mark``: null for all families of a group as soon as any cell of one is below five.

    Families of a group share totals, so one that is shown would give away another that isn't. The mark is ``small`` or,
    for a cell that is large enough itself, ``linked``. Nulls in a group's key are one value.
    """
    least = counts.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min(n).alias("_least"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    small, hidden = F.col(n) < SMALL_CELL, F.col("_least") < SMALL_CELL
    mark = F.when(small, "small").when(hidden, "linked")
    return counts.join(least, same).select(*counts.columns, F.when(~hidden, F.col(n)).alias("shown"), mark.alias("mark"))


def record_issues(verdicts: DataFrame, valuation_run: str, quality_run: str) -> DataFrame:
    """ticker and code of what is wrong with a run's verdicts; sound ones give no row.

    Verdicts have ticker, status, severity (low, medium, high), the six scores, overall_score, valuation_run_id and
    quality_run_id. The score is computed anew and the status from it, which needs usable numbers.
    """
    usable = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False))
    numbers = reduce(lambda a, b: a & b, [usable(c) & F.col(c).between(0, 100) for c in WEIGHTS], usable("overall_score"))
    score = weighted({c: F.col(c) for c in WEIGHTS})
    status = F.when((score >= INVESTIGATE) & (F.col("severity") != "high"), "Investigate").when(score >= WATCH, "Watch").otherwise("Reject")
    found = {
        "committee_unknown_status": ~F.coalesce(F.col("status").isin("Investigate", "Watch", "Reject"), F.lit(False)),
        "committee_unknown_severity": ~F.coalesce(F.col("severity").isin("low", "medium", "high"), F.lit(False)),
        "committee_invalid_numeric_scores": ~numbers,
        "committee_overall_score_mismatch": numbers & ~is_close(score, F.col("overall_score")),
        "committee_status_formula_mismatch": numbers & ~F.col("status").eqNullSafe(status),
        "committee_lineage_mismatch": ~(F.col("valuation_run_id").eqNullSafe(valuation_run) & F.col("quality_run_id").eqNullSafe(quality_run)),
    }
    return verdicts.select("ticker", F.explode(F.array_compact(F.array(*[F.when(c, code) for code, c in found.items()]))).alias("code"))


def replicate_refusal(stored: DataFrame, replicate: DataFrame) -> DataFrame:
    """One row: why a repeated run's verdicts can't measure noise, the first reason that holds; null if they can.

    Both have ticker, reused_from_run_id, quality_run_id, valuation_run_id and cache_key.
    """
    columns = ("reused_from_run_id", "quality_run_id", "valuation_run_id", "cache_key")
    one = lambda df, p: df.groupBy("ticker").agg(F.count("*").alias(f"{p}n"), *[F.first(c).alias(f"{p}{c}") for c in columns])
    both = one(stored, "a_").join(one(replicate, "b_"), "ticker", "full_outer")
    differs = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    found = {
        "ambiguous identifiers": (F.col("a_n") > 1) | (F.col("b_n") > 1),
        "cohorts differ": F.col("a_n").isNull() | F.col("b_n").isNull(),
        "replicate reuses verdicts": F.col("b_reused_from_run_id").isNotNull(),
        "lineage differs": differs("quality_run_id") | differs("valuation_run_id"),
        "inputs differ": differs("cache_key"),
    }
    counts = both.agg(*[F.count_if(c).alias(k) for k, c in found.items()])
    return counts.select(F.coalesce(*[F.when(F.col(k) > 0, k) for k in found]).alias("reason"))
