"""The committee: a persona's reply, the bundle key of what it read, cost, and the gates before a call."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.functions.vectorised import vectorised
from grainledger.operators.evaluation import INVESTIGATE, WATCH, WEIGHTS

#: Statements of a reply, assumed output tokens, and what a batch costs of the price.
FEWEST, MOST, ASSUMED_OUTPUT, BATCH = 4, 8, 8_000, 0.5
# The readers in the order of their calls, the labels under which each gives its scores, and the four kinds of analysis.
READERS = ("quality", "bear", "valuation")
LABELS = {
    "quality": {"BUSINESS_QUALITY": "business", "COMPETITIVE_MOAT": "moat", "MANAGEMENT": "management"},
    "bear": {"RISK": "risk"},
    "valuation": {"VALUATION": "valuation", "FINANCIAL_STRENGTH": "strength"},
}
KINDS = ("business_quality", "moat", "management", "risk")
_STATEMENT = "array<struct<text:string,refs:array<string>>>"
_PART = {
    "verdict": re.compile(r"##\s*VERDICT\s*\n(.*?)(?=\n##\s*SCORES|\Z)", re.S | re.I),
    "scores": re.compile(r"##\s*SCORES\s*\n(.*?)(?=\n##\s*STATEMENTS|\Z)", re.S | re.I),
    "statements": re.compile(r"##\s*STATEMENTS\s*\n(.*)\Z", re.S | re.I),
}
_SCORE = re.compile(r"^([A-Z_]+)\s*:\s*(\d+(?:\.\d+)?)\s*$", re.M)
_SEVERITY = re.compile(r"^SEVERITY\s*:\s*(low|medium|high)\s*$", re.M | re.I)
_LINE = re.compile(r"^STATEMENT:\s*(.+?)(?:\s*\[refs:\s*(.*?)\s*\])?\s*$", re.M)


def _parts(raw: str | None) -> tuple:
    found = {k: (m[1] if (m := r.search(raw or "")) else "") for k, r in _PART.items()}
    severity = _SEVERITY.search(found["scores"])
    statements = [{"text": m[1].strip(), "refs": [t.strip() for t in (m[2] or "").split(",") if t.strip()]} for m in _LINE.finditer(found["statements"])]
    return found["verdict"].strip(), {m[1]: float(m[2]) for m in _SCORE.finditer(found["scores"])}, severity[1].lower() if severity else None, statements


@vectorised(f"struct<verdict:string,said:map<string,double>,severity:string,statements:{_STATEMENT}>")
def reply_parts(raw: pd.Series) -> pd.DataFrame:
    """Verdict, scores by label, severity and statements with their references, as a reply has them; nothing is checked."""
    return pd.DataFrame([_parts(r) for r in raw], columns=["verdict", "said", "severity", "statements"])


def persona_replies(replies: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """replies (keys, persona, raw and others) with verdict, scores (by component), severity, statements and errors.

    ``known`` has keys and refs, the numbers of the claims that the reader was given, as text. Codes of errors: no_verdict, no_score:<label>,
    out_of_range:<label> (the score is then cut to 0 to 100), no_severity (of the bear case), not_a_number:<ref> and unknown_ref:<ref>,
    few_statements, many_statements. The valuation's references that aren't numbers are dropped, since its statements rest on figures.
    """
    met = replies.withColumn("_p", reply_parts("raw")).join(known.select(*keys, F.col("refs").alias("_known")), keys, "left")
    persona, said = F.col("persona"), F.col("_p.said")
    labels = {(p, label): own for p, all_ in LABELS.items() for label, own in all_.items()}
    mine = lambda p: persona == p
    low = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))
    scores = F.map_from_entries(F.array_compact(F.array(*[F.when(mine(p) & said[label].isNotNull(), F.struct(F.lit(own), low(said[label]))) for (p, label), own in labels.items()])))
    refs = F.flatten(F.transform("_p.statements", lambda s: s["refs"]))
    odd = F.array_distinct(F.filter(refs, lambda r: ~r.rlike(r"^\d+\z")))
    numbers = F.transform(F.filter(refs, lambda r: r.rlike(r"^\d+\z")), lambda r: F.regexp_replace(r, r"^0+(?=\d)", ""))
    unknown = F.array_except(numbers, F.coalesce("_known", F.array().cast("array<string>")))
    n = F.size("_p.statements")
    codes = [F.when(F.col("_p.verdict") == "", "no_verdict")]
    codes += [F.when(mine(p) & said[label].isNull(), f"no_score:{label}") for p, label in labels]
    codes += [F.when(mine(p) & ~said[label].between(0, 100), f"out_of_range:{label}") for p, label in labels]
    codes += [F.when(mine("bear") & F.col("_p.severity").isNull(), "no_severity"), F.when(n < FEWEST, "few_statements").when(n > MOST, "many_statements")]
    named = lambda kind, values: F.transform(values, lambda r: F.concat(F.lit(kind), r))
    errors = F.concat(F.array_compact(F.array(*codes)), F.when(mine("valuation"), F.array().cast("array<string>")).otherwise(named("not_a_number:", odd)), named("unknown_ref:", unknown))
    return met.select(*replies.columns, "_p.verdict", scores.alias("scores"), F.when(mine("bear"), F.col("_p.severity")).alias("severity"), F.col("_p.statements").alias("statements"), errors.alias("errors"))


def verdicts(companies: DataFrame, analyses: DataFrame, valuations: DataFrame, cached: DataFrame, replies: DataFrame) -> DataFrame:
    """ticker, outcome, reason, cost, overall_score, status of each asked company: what comes of it, the first gate that holds.

    Companies have ticker, known (a row of the universe) and cap (what may still be spent, null: anything); analyses ticker and analysis_type, all of
    KINDS are needed; valuations and cached ticker; replies, by ``persona_replies``, also failed (the call broke off), stop_reason and cost.
    Readers are called in order while their costs are below the cap; one that fails, refuses or errs ends it, and what was spent till
    then still counts. A company that passes all has a score and a status. Outcomes: api_error, cache_hit, cost_capped, refused,
    validation_failed, persisted.
    """
    have = analyses.where(F.col("analysis_type").isin(*KINDS)).groupBy("ticker").agg(F.collect_set("analysis_type").alias("_kinds"))
    place = F.array_position(F.array(*map(F.lit, READERS)), F.col("persona"))
    said = F.struct(place.alias("place"), "persona", "failed", F.coalesce("stop_reason", F.lit("")).alias("stop"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.array_join("errors", ",").alias("errors"), F.to_json("scores").alias("scores"), "severity")
    calls = replies.where(place > 0).groupBy("ticker").agg(F.sort_array(F.collect_list(said)).alias("_calls"))
    flag = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    met = companies.join(have, "ticker", "left").join(flag(valuations, "_valued"), "ticker", "left").join(flag(cached, "_hit"), "ticker", "left").join(calls, "ticker", "left")
    met = met.withColumn("_calls", F.coalesce("_calls", F.lit(None).cast(met.schema["_calls"].dataType), F.array().cast(met.schema["_calls"].dataType)))
    end = lambda acc, c, outcome, reason, cost: F.struct(cost.alias("cost"), F.lit(outcome).alias("outcome"), reason.alias("reason"))

    def step(acc: Column, c: Column) -> Column:
        spent = acc["cost"] + c["cost"]
        go = F.struct(spent.alias("cost"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason"))
        return (
            F.when(acc["outcome"].isNotNull(), acc)
            .when(F.coalesce(acc["cost"] >= F.col("cap"), F.lit(False)), end(acc, c, "cost_capped", c["persona"], acc["cost"]))
            .when(F.coalesce(c["failed"], F.lit(False)), end(acc, c, "api_error", F.concat(c["persona"], F.lit(" call failed")), acc["cost"]))
            .when(c["stop"] == "refusal", end(acc, c, "refused", c["persona"], spent))
            .when(c["errors"] != "", end(acc, c, "validation_failed", F.concat(c["persona"], F.lit(": "), c["errors"]), spent))
            .otherwise(go)
        )

    start = F.struct(F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    met = met.withColumn("_end", F.aggregate("_calls", start, step))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, KINDS)), F.coalesce("_kinds", F.array().cast("array<string>"))))
    early = lambda outcome, reason: F.struct(F.lit(0.0).alias("cost"), F.lit(outcome).alias("outcome"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    got = (
        F.when(~F.coalesce("known", F.lit(False)), early("api_error", F.lit("no company")))
        .when(F.size(missing) > 0, early("api_error", F.concat(F.lit("missing: "), F.array_join(missing, ","))))
        .when(F.col("_valued").isNull(), early("api_error", F.lit("no valuation"))).when(F.col("_hit"), early("cache_hit", none))
        .when(F.col("_end.outcome").isNotNull(), F.col("_end")).when(F.size("_calls") < len(READERS), F.struct(F.col("_end.cost").alias("cost"), F.lit("api_error").alias("outcome"), F.lit("no reply").alias("reason")))
        .otherwise(F.struct(F.col("_end.cost").alias("cost"), F.lit("persisted").alias("outcome"), none.alias("reason")))
    )
    scores = F.aggregate("_calls", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")), lambda m, c: F.map_concat(m, F.from_json(c["scores"], "map<string,double>")))
    done = F.col("_got.outcome") == "persisted"
    met = met.withColumn("_got", got).withColumn("_scores", F.when(done, scores)).withColumn("_severity", F.array_max(F.transform("_calls", lambda c: c["severity"])))
    score = reduce(Column.__add__, [F.lit(w) * ((100 - F.col("_scores")[k]) if k == "risk" else F.col("_scores")[k]) for k, w in WEIGHTS.items()])
    status = F.when((score >= INVESTIGATE) & (F.col("_severity") != "high"), "Investigate").when(score >= WATCH, "Watch").otherwise("Reject")
    return met.select("ticker", "_got.outcome", "_got.reason", "_got.cost", F.when(done, score).alias("overall_score"), F.when(done, status).alias("status"))


def bundle_key(*parts: Column) -> Column:
    """A key of inputs: each part as text with its length before it, so that no two lists of parts read alike."""
    said = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *said), 256)


def sorted_text(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, and ``rows``: its rows as one canonical text, whatever their order."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("rows"))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with ``cost``, from token counts and prices a million; a model without a price is an error."""
    met = usage.join(F.broadcast(prices), "model", "left")
    total = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    total = total * F.when(F.col("batch"), BATCH).otherwise(1.0)
    return met.withColumn("cost", F.when(F.col("input_price").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model")))).otherwise(total))


def projected_cost(requests: DataFrame, prices: DataFrame, output: int = ASSUMED_OUTPUT) -> DataFrame:
    """Requests (model, input_tokens, batch) with ``projected``, their cost before anything is sent, for an assumed length of the reply."""
    got = cost(requests.withColumn("output_tokens", F.lit(output)), prices)
    return got.select(*requests.columns, F.col("cost").alias("projected"))


def within_cap(projected: DataFrame, cap: float) -> DataFrame:
    """One row: requests, their projected cost, and whether all of them may be sent."""
    return projected.agg(F.count("*").alias("requests"), F.coalesce(F.sum("projected"), F.lit(0.0)).alias("projected")).withColumn("may_send", F.col("projected") <= cap)


def gates(companies: DataFrame, analyses: DataFrame, valuations: DataFrame, cached: DataFrame, needed: list[str]) -> DataFrame:
    """ticker, gate: why a company isn't read anew, or ``call``. Analyses: ticker, analysis_type; cached: ticker."""
    kinds = analyses.where(F.col("analysis_type").isin(needed)).groupBy("ticker").agg(F.count_distinct("analysis_type").alias("kinds"))
    met = companies.select("ticker").distinct().join(kinds, "ticker", "left")
    met = met.join(valuations.select("ticker", F.lit(True).alias("valued")).distinct(), "ticker", "left").join(cached.select("ticker", F.lit(True).alias("hit")).distinct(), "ticker", "left")
    gate = F.when(F.coalesce("kinds", F.lit(0)) < len(needed), "analysis missing").when(F.col("valued").isNull(), "valuation missing").when(F.col("hit"), "cached").otherwise("call")
    return met.select("ticker", gate.alias("gate"))


def replies(requests: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """custom_id and reply of each request (custom_id, prompt): the provider is called in the tasks, one row at a time.

    Without a network the provider looks replies up that were recorded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"custom_id": frame["custom_id"], "reply": [provider(p) for p in frame["prompt"]]})

    return requests.select("custom_id", "prompt").mapInPandas(run, "custom_id string, reply string")


def outcome(cache_hit: Column, refused: Column, error: Column, invalid: Column, covered: Column) -> Column:
    """What becomes of a reply, first that holds."""
    return F.when(cache_hit, "cache_hit").when(refused, "refused").when(error.isNotNull(), "api_error").when(invalid, "validation_failed").when(covered < 1, "coverage_below_one").otherwise("persisted")
