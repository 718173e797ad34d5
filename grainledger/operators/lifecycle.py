"""Attempts of a batch, from its submission to their ends, as tables that can be merged again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of an attempt.
PENDING, REFUSED, API_ERROR, INVALID, PERSISTED = "pending", "refusal", "api_error", "validation_failed", "persisted"
ATTEMPT = "custom_id string, run_id string, ticker string, batch_id string, model_id string, prompt_sha256 string, outcome string, failure string, cost double, attempt int"


def submitted(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """``attempts`` with a pending row for each request (run_id, ticker, batch_id, model_id, prompt_sha256).

    custom_id is the ticker, 16 signs of the prompt's hash and 8 of the batch's and the number of the try, so that a prompt which is sent again
    has another. A request that its batch has already isn't added again, so a submission may be repeated.
    """
    new = requests.dropDuplicates(["batch_id", "ticker"]).join(attempts.select("batch_id", "ticker"), ["batch_id", "ticker"], "left_anti")
    tries = attempts.groupBy("ticker", "prompt_sha256").agg(F.max("attempt").alias("_last"))
    new = new.join(tries, ["ticker", "prompt_sha256"], "left").withColumn("attempt", (F.coalesce("_last", F.lit(0)) + 1).cast("int"))
    suffix = F.substring(F.sha2(F.concat_ws("/", "batch_id", F.col("attempt").cast("string")), 256), 1, 8)
    rows = new.select(
        F.concat_ws("_", "ticker", F.substring("prompt_sha256", 1, 16), suffix).alias("custom_id"), "run_id", "ticker", "batch_id", "model_id", "prompt_sha256",
        F.lit(PENDING).alias("outcome"), F.lit(None).cast("string").alias("failure"), F.lit(0.0).alias("cost"), "attempt",
    )
    return attempts.unionByName(rows)


def retrieved(attempts: DataFrame, batch: str | tuple[str, ...], results: DataFrame, issues: DataFrame) -> DataFrame:
    """``attempts`` with the ends of the pending rows of the batch, or of several at once, for which there are results; all others stay as they are.

    Results have custom_id, stop_reason and cost, issues custom_id and code. A refusal or an error of the service has no content to check; else
    an attempt with issues is invalid, with their codes as its failure, and one without is persisted. A result of no
    pending row changes nothing, and neither does the same call again. Of several results of one id the first by reason counts.
    """
    end = results.groupBy("custom_id").agg(F.min(F.struct("stop_reason", "cost")).alias("_r")).select("custom_id", "_r.stop_reason", F.col("_r.cost").alias("_cost"))
    wrong = issues.groupBy("custom_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("_codes"))
    met = attempts.join(end, "custom_id", "left").join(wrong, "custom_id", "left")
    due = F.col("batch_id").isin(*((batch,) if isinstance(batch, str) else batch)) & (F.col("outcome") == PENDING) & F.col("stop_reason").isNotNull()
    apart = F.col("stop_reason").isin(REFUSED, API_ERROR)
    outcome = F.when(apart, F.col("stop_reason")).when(F.col("_codes").isNotNull(), INVALID).otherwise(PERSISTED)
    failure = F.when(~apart, F.col("_codes"))
    new = {"outcome": outcome, "failure": failure, "cost": F.when(apart, 0.0).otherwise(F.coalesce("_cost", F.lit(0.0)))}
    return met.select(*[F.when(F.coalesce(due, F.lit(False)), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in attempts.columns])


def summary(attempts: DataFrame) -> DataFrame:
    """batch_id, outcome, n and cost."""
    return attempts.groupBy("batch_id", "outcome").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
