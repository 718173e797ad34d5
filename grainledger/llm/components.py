"""Connected components of links by rounds of joins; nothing passes the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainledger.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in a link; component is the smallest id that is reachable.

    Each round, a node hands the smallest of its neighbours and itself to its larger neighbours (large star), then
    to its smaller ones and itself (small star), until no link changes. Rounds grow with the logarithm of the
    longest path. Minima are taken by partial aggregation, and joined back, so that a node with very many links
    is spread over tasks.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
    edges = cut(edges)
    before = state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", "m")).distinct()
        edges = cut(small)
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
