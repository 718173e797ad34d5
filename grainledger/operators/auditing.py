"""Checks of recorded runs: chains of reuse, bundles of inputs, closed values, admissible repeats and replays of fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.operators.evaluation import INVESTIGATE, WATCH, WEIGHTS, weighted
from grainledger.operators.valuation import value_class
from grainledger.functions.measures import is_close
from grainledger.session import cut

# Codes of faults, closed values of recorded rows, reasons why a repeat can't measure noise, in their order.
CYCLE, SOURCE_MISSING, KEY_DIFFERS = "committee_reuse_cycle", "committee_reuse_source_missing", "committee_cache_key_mismatch"
INPUTS_INCOMPLETE, BUNDLE_DIFFERS = "committee_cache_bundle_inputs_incomplete", "committee_cache_bundle_mismatch"
METRICS = ("debt_to_fcf", "dilution", "fcf_margin", "gross_margin", "operating_margin", "revenue_growth", "roe", "roic")
STATUSES = ("pass", "fail", "unavailable", "not_applicable")
SHAPES = (("owner_earnings_dcf", "bear"), ("owner_earnings_dcf", "base"), ("owner_earnings_dcf", "bull"), ("pe_vs_own_history", "point"), ("fcf_yield", "point"), ("reverse_dcf", "point"))
LEAST_ASSESSED, LEAST_SCORE = 6, 50.0
REFUSALS = (
    "replicate_run_id_not_supplied",
    "replicate_run_id_is_not_distinct_from_every_frozen_run",
    "replicate_database_not_supplied",
    "candidate_snapshot_does_not_match_equivalence_reference",
    "replicate_database_aliases_candidate_snapshot",
    "replicate_run_not_found_in_replicate_snapshot",
    "equivalent_runtime_environment_not_evidenced",
    "replicate_run_did_not_complete_committee_stage",
    "committee_cohort_contains_ambiguous_canonical_identifiers",
    "replicate_cohort_does_not_equal_stored_candidate_cohort",
    "replicate_contains_cache_reused_verdicts",
    "committee_verdict_lineage_does_not_match_frozen_candidate_inputs",
    "committee_bundle_equivalence_failed",
    "no_preflight_valid_paired_companies",
)


def reuse_faults(rows: DataFrame, run: str = "run_id", within: str = "ticker", source: str = "reused_from_run_id", key: str = "cache_key") -> DataFrame:
    """run, within, code of each row whose chain of reuse is unsound; sound ones give no row.

    A row names the run that it was copied from, by which the row of that run and the same company is meant. The first fault
    on the way to a row that was not copied counts: its source is missing, its source's key isn't its own, or there is no such row,
    since the way runs in a circle. Two nulls are the same key. A row is known by (run, within); of several one is taken.

    Each round every open row takes over what the row that it points at knows, and points where that one pointed, so a
    chain of n rows takes log2(n) joins. When a round settles none, what is open leads into a circle.
    """
    k = lambda *names: F.struct(*[F.col(n) for n in names])
    known = rows.select(k(run, within).alias("node"), F.when(F.col(source).isNotNull(), k(source, within)).alias("to"), F.col(key).alias("key")).dropDuplicates(["node"])
    target = known.select(F.col("node").alias("to"), F.lit(True).alias("there"), F.col("key").alias("its"))
    copied = F.col("to").isNotNull()
    fault = F.when(copied & F.col("there").isNull(), SOURCE_MISSING).when(copied & ~F.col("key").eqNullSafe(F.col("its")), KEY_DIFFERS)
    now = cut(known.join(target, "to", "left").select("node", "to", fault.alias("fault"), (copied & fault.isNull()).alias("open")))
    left = now.where("open").count()
    while left:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("fault").alias("its_fault"), F.col("open").alias("its_open"))
        moved = now.where("open").join(ahead, "to").select("node", F.col("next").alias("to"), F.col("its_fault").alias("fault"), F.col("its_open").alias("open"))
        now = cut(now.where("not open").unionByName(moved))
        still = now.where("open").count()
        if still == left:
            break
        left = still
    code = F.when(F.col("open"), CYCLE).otherwise(F.col("fault"))
    return now.select(F.col(f"node.{run}").alias(run), F.col(f"node.{within}").alias(within), code.alias("code")).where("code is not null")


def bundle_issues(rows: DataFrame, bundles: DataFrame, by: list[str], key: str = "cache_key", bundle: str = "bundle") -> DataFrame:
    """by, code of each row whose key isn't the one that its inputs give; a missing or null bundle means that inputs lack."""
    met = rows.select(*by, F.col(key).alias("_key")).join(bundles.select(*by, F.col(bundle).alias("_bundle")), by, "left")
    code = F.when(F.col("_bundle").isNull(), INPUTS_INCOMPLETE).when(~F.col("_bundle").eqNullSafe(F.col("_key")), BUNDLE_DIFFERS)
    return met.select(*by, code.alias("code")).where("code is not null")


def domain_issues(quality: DataFrame, quant: DataFrame, valuations: DataFrame) -> DataFrame:
    """One row a rule: rule and n, the rows that break it; a table without rows breaks its own rule once.

    Quality has passed_screen (0 or 1) and metrics_assessed, metrics_passed (null or 0 to 8); quant metric and status; valuations
    method and scenario.
    """
    known = lambda c, *values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    counted = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 8)
    shape = reduce(lambda a, b: a | b, [F.col("method").eqNullSafe(m) & F.col("scenario").eqNullSafe(s) for m, s in SHAPES])
    one = lambda df, name, **rules: df.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias(f"{name}_empty"), *[F.count_if(bad).alias(rule) for rule, bad in rules.items()])
    got = [
        one(quality, "quality", quality_unknown_screen=~known("passed_screen", 0, 1), quality_invalid_counts=counted("metrics_assessed") | counted("metrics_passed")),
        one(quant, "quant", quant_unknown_category=~known("metric", *METRICS) | ~known("status", *STATUSES)),
        one(valuations, "valuation", valuation_unknown_shape=~shape),
    ]
    long = [f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in f.columns])).alias("r")).select("r.*") for f in got]
    return reduce(DataFrame.unionByName, long)


def sound_verdict() -> Column:
    """Whether a verdict has known values, usable scores, and the score and status that follow from these."""
    usable = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False))
    numbers = reduce(lambda a, b: a & b, [usable(c) & F.col(c).between(0, 100) for c in WEIGHTS], usable("overall_score"))
    score = weighted({c: F.col(c) for c in WEIGHTS})
    status = F.when((score >= INVESTIGATE) & (F.col("severity") != "high"), "Investigate").when(score >= WATCH, "Watch").otherwise("Reject")
    return F.coalesce(F.col("severity").isin("low", "medium", "high") & numbers & is_close(score, F.col("overall_score")) & (F.col("status") == status), F.lit(False))


def admissibility(
    stored: DataFrame, replicate: DataFrame | None, runs: DataFrame | None, bundles: DataFrame, replicate_bundles: DataFrame | None, *, replicate_run: str | None, frozen_runs: list[str], quality_run: str,
    valuation_run: str, digests: tuple[str | None, str | None, str | None], aliased: bool, provenance: str | None, invalid: DataFrame | None = None,
) -> DataFrame:
    """One row: reason, the first of REFUSALS that holds, null if none does, and detail: what failed of the bundles, as JSON.

    Stored and repeated verdicts have ticker, reused_from_run_id, quality_run_id, valuation_run_id, cache_key, status, severity, the six scores
    and overall_score; runs (of the repeat's snapshot) run_id, stage_reached and status; bundles ticker and bundle (null: inputs lack).
    ``digests``: of the candidate's snapshot as the reference, the manifest and the file have it. ``invalid``: tickers that abstain.
    Only counts leave the joins, so either side may be of any size.
    """
    spark = stored.sparkSession
    alike = digests[0] is not None and digests[0] == digests[1] == digests[2]
    first = [not replicate_run, replicate_run in frozen_runs, replicate is None, not alike, aliased]
    if any(first):
        return spark.createDataFrame([(REFUSALS[first.index(True)], None)], "reason string, detail string")
    run = runs.where(F.col("run_id") == replicate_run).agg(F.count("*").alias("runs"), F.max(F.col("stage_reached").isin("committee", "monitor") & F.col("status").isin("complete", "partial")).alias("reached"))
    columns = ("reused_from_run_id", "quality_run_id", "valuation_run_id", "cache_key")
    side = lambda df, p: df.select("*", sound_verdict().alias("sound")).groupBy("ticker").agg(F.count("*").alias(f"{p}n"), F.min("sound").alias(f"{p}sound"), *[F.first(c).alias(f"{p}{c}") for c in columns])
    key = lambda df, p: df.select("ticker", F.col("bundle").alias(f"{p}bundle"))
    both = side(stored, "a_").join(side(replicate, "b_"), "ticker", "full_outer").join(key(bundles, "a_"), "ticker", "left").join(key(replicate_bundles, "b_"), "ticker", "left")
    barred = (invalid if invalid is not None else stored.limit(0)).select("ticker").distinct().withColumn("barred", F.lit(True))
    both = both.join(barred, "ticker", "left")
    lineage = lambda p: ~(F.col(f"{p}quality_run_id").eqNullSafe(quality_run) & F.col(f"{p}valuation_run_id").eqNullSafe(valuation_run))
    a, b = F.col("a_bundle"), F.col("b_bundle")
    failures = {
        "candidate_bundle_unavailable": a.isNull(),
        "replicate_bundle_unavailable": b.isNull(),
        "candidate_cache_key_mismatch": a.isNotNull() & ~a.eqNullSafe(F.col("a_cache_key")),
        "replicate_cache_key_mismatch": b.isNotNull() & ~b.eqNullSafe(F.col("b_cache_key")),
        "cross_snapshot_bundle_mismatch": F.coalesce(a != b, F.lit(False)),
    }
    counts = both.agg(
        F.count_if((F.col("a_n") > 1) | (F.col("b_n") > 1)).alias("ambiguous"), F.count_if(F.col("a_n").isNull() | F.col("b_n").isNull()).alias("cohort"), F.count_if(F.col("b_reused_from_run_id").isNotNull()).alias("reused"),
        F.count_if(lineage("a_") | lineage("b_")).alias("lineage"), F.count_if(F.col("a_sound") & F.col("b_sound") & F.col("barred").isNull()).alias("paired"), *[F.count_if(c).alias(k) for k, c in failures.items()],
    ).crossJoin(run)  # one row each
    failed = sum(F.col(k) for k in failures) > 0
    tests = [F.col("runs") == 0, F.lit(not provenance), ~F.coalesce("reached", F.lit(False)), F.col("ambiguous") > 0, F.col("cohort") > 0, F.col("reused") > 0, F.col("lineage") > 0, failed, F.col("paired") == 0]
    reason = F.coalesce(*[F.when(t, r) for t, r in zip(tests, REFUSALS[5:])])
    detail = F.when(reason == REFUSALS[12], F.to_json(F.struct(*[F.nullif(F.col(k), F.lit(0)).alias(k) for k in sorted(failures)])))
    return counts.select(reason.alias("reason"), detail.alias("detail"))


def _screen(statuses: Column) -> Column:
    values = F.map_values(statuses)
    assessed = F.size(F.filter(values, lambda v: v.isin("pass", "fail")))
    passed = F.size(F.filter(values, lambda v: v == "pass"))
    score = F.when(assessed > 0, 100.0 * passed / assessed).otherwise(0.0)
    return F.struct(assessed.alias("assessed"), passed.alias("passed"), score.alias("score"), ((assessed >= LEAST_ASSESSED) & (score >= LEAST_SCORE)).alias("passed_screen"))


def replays(records: DataFrame, frozen_screens: DataFrame, frozen_values: DataFrame) -> DataFrame:
    """fix_id, ticker, stage, assessed_before, score_before, assessed_after, score_after, transition, fault: what one fix alone changes.

    Records have fix_id, ticker, stage, evidence, held_constant, before_metrics and after_metrics (map of metric to status), before_values and
    after_values (struct of bear, base, bull, price). A state is computed anew from what it claims; a record whose
    claimed state before the fix isn't the frozen row (ticker, metrics; ticker, values) is refused, as is one of an unknown stage, metric or
    status, without evidence, or that doesn't attest that all else was held constant. Refused records have a fault and no transition.
    """
    met = records.join(frozen_screens.select("ticker", F.col("metrics").alias("_metrics")), "ticker", "left").join(frozen_values.select("ticker", F.col("values").alias("_values")), "ticker", "left")
    screen, value = F.col("stage") == "screen", F.col("stage") == "valuation"
    sorted_ = lambda c: F.array_sort(F.map_entries(c))
    names = lambda c: F.array_sort(F.map_keys(c))
    all_metrics = F.array(*map(F.lit, sorted(METRICS)))
    wrong_names = ~names(F.col("before_metrics")).eqNullSafe(all_metrics) | ~names(F.col("after_metrics")).eqNullSafe(all_metrics)
    unknown = lambda c: F.coalesce(F.exists(F.map_values(c), lambda v: ~F.coalesce(v.isin(*STATUSES), F.lit(False))), F.lit(True))
    same = F.when(screen, sorted_(F.col("before_metrics")).eqNullSafe(sorted_(F.col("_metrics"))) & F.col("_metrics").isNotNull()).otherwise(F.col("before_values").eqNullSafe(F.col("_values")) & F.col("_values").isNotNull())
    fault = (
        F.when(~F.coalesce(screen | value, F.lit(False)), "unknown_stage").when(F.coalesce(F.length("fix_id") == 0, F.lit(True)) | F.coalesce(F.length("evidence") == 0, F.lit(True)), "evidence_missing")
        .when(~F.coalesce("held_constant", F.lit(False)), "not_held_constant").when(screen & wrong_names, "unknown_metrics").when(screen & (unknown("before_metrics") | unknown("after_metrics")), "unknown_status")
        .when(value & (F.col("before_values").isNull() | F.col("after_values").isNull()), "unknown_values").when(~same, "before_is_not_frozen")
    )
    cls = lambda c: value_class(F.col(f"{c}.bear"), F.col(f"{c}.base"), F.col(f"{c}.bull"), F.col(f"{c}.price"), F.lit(3), F.lit(True))[0]
    named = lambda c: F.when(F.col(f"{c}.passed_screen"), "pass").otherwise("fail")
    met = met.withColumn("fault", fault).withColumn("_a", F.when(screen, _screen(F.col("before_metrics")))).withColumn("_b", F.when(screen, _screen(F.col("after_metrics"))))
    ends = F.when(screen, F.concat(named("_a"), F.lit("_to_"), named("_b"))).otherwise(F.concat(cls("before_values"), F.lit("_to_"), cls("after_values")))
    sound = F.col("fault").isNull()
    return met.select(
        "fix_id", "ticker", "stage", *[F.when(sound, F.col(f"{s}.{c}")).alias(f"{c}_{name}") for s, name in (("_a", "before"), ("_b", "after")) for c in ("assessed", "score")], F.when(sound, ends).alias("transition"), "fault",
    )
