"""Merges of tables by key, on plain files: the result is a new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.operators.series import top_row


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """All keys of both; a key's new row replaces its old one, the last in ``order`` where new has several."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return top_row(both, keys, F.desc("_batch"), *[F.desc(c) for c in order]).drop("_batch")


def fill_upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """Columns in ``keep`` take the new value unless it is null; those in ``replace`` take it as it is."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in keep + replace], F.lit(True).alias("_there"))
    both = old.join(n, old[key] == n["_key"], "full_outer")
    kept = [F.coalesce(f"_{c}", c).alias(c) for c in keep]
    replaced = [F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in replace]
    return both.select(F.coalesce("_key", key).alias(key), *kept, *replaced)


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])


def retaining_upsert(old: DataFrame, new: DataFrame, keys: list[str], retain: list[str], *order: str) -> DataFrame:
    """All keys of both; a key's new row replaces its old one but for ``retain``, which keep what was first stored, also a null.

    Of several new rows of a key the last in ``order`` counts. Null keys are keys like others.
    """
    latest = top_row(new, keys, *[F.desc(c) for c in order])
    n = latest.select(*[F.col(c).alias(f"_new_{c}") for c in old.columns], F.lit(True).alias("_there"))
    met = old.withColumn("_here", F.lit(True)).join(n, _same(keys), "full_outer")
    pick = lambda c: F.when(F.col("_here") & (F.lit(c in retain or c in keys) | F.col("_there").isNull()), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
    return met.select(*[pick(c) for c in old.columns])


def partial_upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], *order: str) -> DataFrame:
    """Old rows with the columns ``update`` of their key's new row, nulls too; keys that aren't there yet are not added."""
    n = top_row(new, keys, *[F.desc(c) for c in order]).select(*[F.col(c).alias(f"_new_{c}") for c in (*keys, *update)], F.lit(True).alias("_there"))
    met = old.join(n, _same(keys), "left")
    return met.select(*[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else c for c in old.columns])


def upsert_attempts(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """As ``latest_wins`` for a key that may be null: rows without one never replace each other, and all stay."""
    keyed = latest_wins(old.where(F.col(key).isNotNull()), new.where(F.col(key).isNotNull()), [key], *order)
    rest = old.where(F.col(key).isNull()).unionByName(new.where(F.col(key).isNull()), allowMissingColumns=True)
    return keyed.unionByName(rest, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_run(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of other runs, and all new rows; keys are compared null-safe, so a null part doesn't double rows."""
    mine = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & old[k].eqNullSafe(mine[f"_{k}"])
    return old.join(mine, same, "left_anti").unionByName(new)


def merged_universe(first: DataFrame, second: DataFrame) -> DataFrame:
    """Columns ticker, name, sector, tags (comma-joined): the first source's values are preferred, tags are united."""
    b = second.select("ticker", F.col("name").alias("_name"), F.col("sector").alias("_sector"), F.col("tags").alias("_tags"))
    tags = F.array_sort(F.array_union(F.split(F.coalesce("tags", F.lit("")), ","), F.split(F.coalesce("_tags", F.lit("")), ",")))
    return first.join(b, "ticker", "full_outer").select(
        "ticker", F.coalesce("name", "_name").alias("name"), F.coalesce("sector", "_sector").alias("sector"),
        F.array_join(F.filter(tags, lambda t: t != ""), ",").alias("tags"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """keys, column, before, after of the shared rows' cells that differ by more than rounding; one null differs."""
    a = before.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "column", "before")
    b = after.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "column", "after")
    near = F.abs(F.col("before") - F.col("after")) <= F.greatest(F.lit(relative) * F.greatest(F.abs("before"), F.abs("after")), F.lit(absolute))
    one_null = F.col("before").isNull() != F.col("after").isNull()
    return a.join(b, [*keys, "column"]).where(one_null | ~near)
