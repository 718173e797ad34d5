"""Chains of rows that reuse an earlier run, and the choice of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainledger.session import cut


def chain_roots(links: DataFrame, node: str, parent: str, hops: int = 30) -> DataFrame:
    """node, root and hops of each row, following parents until there is none; a cycle has a null root.

    Pointers are doubled each round, so that a chain of ``2 ** hops`` takes ``hops`` joins, and rounds end as soon as
    nothing moves.
    """
    links = cut(links.select(node, parent))
    now = links.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("at"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("hops"))
    parents = links.where(F.col(parent).isNotNull()).select(F.col(node).alias("at"))
    open_ = None
    for _ in range(hops):
        step = now.select(F.col("node").alias("at"), F.col("at").alias("_next"), F.col("hops").alias("_more"))
        now = cut(now.join(step, "at", "left").select("node", F.coalesce("_next", "at").alias("at"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops")))
        # rows that aren't at an end yet; fewer each round, but for those in a cycle
        left = now.join(parents, "at", "left_semi").count()
        if not left or left == open_:
            break
        open_ = left
    ends = links.where(F.col(parent).isNull()).select(F.col(node).alias("at"), F.lit(True).alias("_end"))
    known = links.select(F.col(node).alias("at"), F.lit(True).alias("_known"))
    out = now.join(ends, "at", "left").join(known, "at", "left")
    there = F.coalesce("_end", F.lit(False)) | F.col("_known").isNull()
    return out.select(F.col("node").alias(node), F.when(there, F.col("at")).alias("root"), F.when(there, F.col("hops")).alias("hops"))


def latest_run(runs: DataFrame, having: DataFrame, run: str, started: str, status: str) -> DataFrame:
    """The newest run that didn't fail and has rows."""
    some = runs.where(F.col(status) != "failed").join(having.select(run).distinct(), run, "left_semi")
    return some.agg(F.max_by(run, F.struct(started, run)).alias(run))
