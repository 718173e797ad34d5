"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a hashed order and are cut into blocks of about equal size. A source's quota is
the number of block draws that reach its target: a permutation of its blocks, then a second one where the target
exceeds the source. The tree starts from the quotas of all sources and splits them between two halves of the
output shards by a multivariate hypergeometric draw, and so on down to single shards, so that every shard gets a
random mix and all quotas come out exactly. The shards then take disjoint runs of the permuted blocks, and order
their documents by a hash. Of the last block drawn of a source, documents are taken until the target is reached,
the last of them in part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.llm.common import WORD, set_aside, table

SHARE, MOST, WEIGHTS = 1.5, 2.0, (3, 1, 2)
#: Blocks of a source, about, while there are fewer than a quarter as many shards.
BLOCKS = 1024
#: Documents that one prefix sum runs over, about.
RUN = 4096


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares by weight, none above ``most`` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        each = rest / sum(weight[s] for s in sorted(open_, key=names.index))
        full = {s for s in open_ if each * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        rest -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block draws of each shard (rows) and source (columns); columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        low, high, left = nodes.pop()
        if high - low == 1:
            out[low] = left
            continue
        middle = (low + high) // 2
        n = int(left.sum()) * (middle - low) // (high - low)
        drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(left, n, method="marginals")
        nodes += [(low, middle, drawn), (middle, high, left - drawn)]
    return out


def shards_for(bytes_: int) -> int:
    """Shards of 16 MB; 64 of them from 1 GB on, and of 256 MB each from 16 GB on."""
    return max(1, -(-bytes_ // min(256 << 20, max(16 << 20, bytes_ // 64))))


def _plan(blocks: np.ndarray, goal: dict, shards: int, seed: int) -> list[tuple]:
    """For each block (rows: source number, block, first word, words): for either draw its shard and the words to take."""
    blocks = blocks[np.lexsort((blocks[:, 1], blocks[:, 0]))]
    sids, starts = np.unique(blocks[:, 0], return_index=True)
    ends, draws = np.append(starts[1:], len(blocks)), []
    for sid, a, b in zip(sids.tolist(), starts.tolist(), ends.tolist()):
        rng, words = np.random.default_rng([seed, sid]), np.tile(blocks[a:b, 3], 2)
        order = np.concatenate([rng.permutation(b - a), rng.permutation(b - a) + b - a])
        before = np.concatenate([[0], np.cumsum(words[order])[:-1]])
        take = np.clip(int(goal[sid]) - before, 0, words[order])
        draws.append((order[take > 0], take[take > 0]))
    shares = split(np.array([len(d[0]) for d in draws], np.int64), shards, seed)
    out = []
    for column, (sid, a, b, (order, take)) in enumerate(zip(sids.tolist(), starts.tolist(), ends.tolist(), draws)):
        shard, words = np.full(2 * (b - a), -1, np.int64), np.zeros(2 * (b - a), np.int64)
        shard[order], words[order] = np.repeat(np.arange(shards), shares[:, column]), take
        for k, (s0, t0, s1, t1) in enumerate(zip(*(x.tolist() for x in (shard[: b - a], words[: b - a], shard[b - a :], words[b - a :])))):
            out.append((sid, int(blocks[a + k, 1]), int(blocks[a + k, 2]), s0 if s0 >= 0 else None, t0, s1 if s1 >= 0 else None, t1))
    return out


def mix(docs: DataFrame, keep: list[str] | None = None, shards: int | None = None, seed: int = 20, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each document once, with what the mix takes of it.

    Columns: doc_id, source, size, source_size, target, taken, and for the two draws ``shard_0, taken_0, place_0``
    and ``shard_1, taken_1, place_1`` (null shard: not drawn; place: order within the shard), then ``keep``, of which none
    may be called like one of these (``set_aside`` renames them). Without ``shards`` their number follows from the bytes.
    A null text has size 0. A null source is a source, the last one. A null id is an id like another. Rows that
    repeat an id are documents of their own. Documents of size 0 are never taken. An empty table gives no rows.
    One row for each source, and the plan, pass the driver; documents don't. The plan holds 1024 blocks of a source at
    most, or about four for each shard where that is more.
    """
    keep = keep or []
    # the text in the hash: the order is total but for rows that are equal in id and text
    turn = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), turn.alias("turn"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    spark = docs.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    if shards is None:
        shards = shards_for(int(share * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)))
    sizes = {r["source"]: r["words"] for r in totals}
    goal = targets(sizes, weights, share, most)
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    index = {s: i for i, s in enumerate(names)}
    count = {r["source"]: r["n"] for r in totals}
    # words of a block: a 1024th of the source, or a quarter of a shard's share of it
    each = {s: max(1, -(-sizes[s] // BLOCKS) if 4 * shards <= BLOCKS else -(-sum(sizes.values()) // (4 * shards))) for s in names}
    rows = [(index[s], s, sizes[s], float(goal[s]), max(1, count[s] // RUN), each[s]) for s in names]
    sources = spark.createDataFrame(rows, "sid int, name string, source_size long, target double, runs long, each long")
    sources = F.broadcast(sources) if len(rows) <= 100_000 else sources

    # where each document starts in its source's order: prefix sums inside a run, on top of the runs' own
    laid = sized.join(sources, sized["source"].eqNullSafe(sources["name"])).withColumn("run", F.pmod("turn", "runs")).drop("name")
    in_run = W.partitionBy("sid", "run")
    ordered = in_run.orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    runs = laid.groupBy("sid", "run").agg(F.sum("size").alias("words"))
    runs = runs.select("sid", "run", F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    laid = laid.withColumn("inside", F.coalesce(F.sum("size").over(ordered), F.lit(0))).join(runs, ["sid", "run"])
    laid = laid.withColumn("first", F.col("base") + F.col("inside")).withColumn("block", F.floor(F.col("first") / F.col("each")))
    blocks = laid.groupBy("sid", "block").agg(F.min("first").alias("first"), F.sum("size").alias("words")).collect()

    plan = _plan(np.array(blocks, np.int64).reshape(-1, 4), {index[s]: goal[s] for s in names}, shards, seed)
    plan = spark.createDataFrame(plan, "sid int, block long, block_first long, shard_0 int, t0 long, shard_1 int, t1 long")
    got = laid.join(F.broadcast(plan) if len(blocks) <= 500_000 else plan, ["sid", "block"])
    for e in "01":
        part = F.least(F.col("size"), F.greatest(F.lit(0), F.col(f"t{e}") - (F.col("first") - F.col("block_first"))))
        got = got.withColumn(f"taken_{e}", part.cast("long"))
        got = got.withColumn(f"place_{e}", F.xxhash64("turn", "first", F.lit(int(e))))
    return got.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("taken_0") + F.col("taken_1")).alias("taken"),
        "shard_0", "taken_0", "place_0", "shard_1", "taken_1", "place_1", *[F.col(f"kept_{c}").alias(c) for c in keep],
    )


def mixed(docs: DataFrame, shards: int | None = None, seed: int = 20) -> DataFrame:
    """The mix itself: a row for each draw of a document, in shards, each in its own shuffled order.

    A document taken in part keeps its first words, joined by single spaces, and ``n_chars``, if there is one, counts the
    characters left. Columns are those of the documents, whatever their names; a partition holds whole shards in order.
    """
    if shards is None:
        shards = shards_for(int(SHARE * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)))
    plain, back = set_aside(docs, "doc_id", "source", "text", "n_chars")
    got = mix(plain, keep=[c for c in plain.columns if c not in ("doc_id", "source")], shards=shards, seed=seed)
    draw = F.explode(F.array(*[F.struct(F.col(f"shard_{e}").alias("shard"), F.col(f"place_{e}").alias("place"), F.col(f"taken_{e}").alias("words")) for e in "01"]))
    got = got.withColumn("draw", draw).where("draw.words > 0")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int"))
    got = got.withColumn("text", F.when(F.col("draw.words") == F.col("size"), F.col("text")).otherwise(F.array_join(words, " ")))
    if "n_chars" in plain.columns:
        got = got.withColumn("n_chars", F.length("text").cast("long"))
    return back(got.withColumn("in_shard", F.col("draw.shard")).repartition(shards, "in_shard").sortWithinPartitions("in_shard", "draw.place"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "shard_0", "taken_0", "shard_1", "taken_1")
