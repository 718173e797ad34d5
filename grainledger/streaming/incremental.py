"""Incremental loads as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainledger.sources.versions import merging


def merge_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], *order: str) -> StreamingQuery:
    """Keeps under ``path`` the latest row of each key, as batches come; ``versions.merged`` reads it.

    A batch is written as a run of its own and runs are joined level by level, so work follows the batch, not the table. A
    batch that is run again after a restart writes the same again.
    """
    return stream.writeStream.foreachBatch(merging(path, keys, list(order))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_prices(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Prices after each ticker's last stored day; an empty batch is an error, one with old days only isn't."""
    if batch.isEmpty():
        raise ValueError("the price batch is empty")
    last = stored.groupBy("ticker").agg(F.max("date").alias("_last"))
    return batch.join(last, "ticker", "left").where(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last").dropDuplicates(["ticker", "date"])


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and kind, of a stream or a table; a stream drops what comes later than ``late``."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def run_diff(before: DataFrame, after: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """Changes between two runs: key, trigger (entered, left, or the column that changed), before, after."""
    a = before.select(F.col(key).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in watched])
    b = after.select(F.col(key).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in watched])
    met = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    one = lambda t, x, y: F.struct(F.lit(t).alias("trigger"), x.cast("string").alias("before"), y.cast("string").alias("after"))
    none = F.lit(None)
    found = [F.when(F.col("_a").isNull(), one("entered", none, none)), F.when(F.col("_b").isNull(), one("left", none, none))]
    found += [F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), one(c, F.col(f"a_{c}"), F.col(f"b_{c}"))) for c in watched]
    return met.select(F.coalesce("_a", "_b").alias(key), F.inline(F.array_compact(F.array(*found))))
