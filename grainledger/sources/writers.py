"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces the partitions of the runs in df and leaves others alone; a rerun gives the same files' rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def current_events(events: DataFrame, key: str, at: str) -> DataFrame:
    """The state of an append-only log: each key's latest event."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, *[c for c in others if c != at])).alias("_e")).select(key, "_e.*")


def portable_digest(df: DataFrame) -> DataFrame:
    """One row: n, mixed and summed of a table's cells as texts, by SHA-256, so that any engine that writes them alike gives the same.

    A row's cells stand behind their lengths, nulls apart; the first 15 signs of its hash are a number, of which the exclusive or and the sum are
    kept. Neither depends on the order of rows; the sum counts repeats.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", *[cell(c) for c in df.columns]), 256), 1, 15), 16, 10).cast("long")
    return df.select(number.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("summed"))
