"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one class, and its smallest id goes on.
2. Each vector belongs to the shards of its nearest centroids (``OVERLAP`` of them). A shard with very many members
   is dealt into blocks of a bounded size.
3. In each block a graph is built: a node's candidates are its nearest members and a few chance ones, and robust
   pruning keeps those that no kept neighbour is much nearer to. The adjacency lists that a node got in its several
   shards are united.
4. Each vector is searched for in all blocks of its first shard: greedy search from the block's medoid with a beam,
   which then expands its range: as long as a node within range has neighbours in range, they are looked at too.
5. Links found are verified by cosine in double precision; each task sends how many each query has, and as many of the
   links as join the same vectors. An audit compares vectors with all rows, block by block,
   until enough that have links were met; if too small a share of the links was found, on the average of these
   vectors, the overlap and beam grow and the search is done again. Where the widest search is still not enough, this
   is an error. Where hardly any vector has a link, the audit ends at a number of vectors that costs about as much as
   the search; then a wider search is done too, and a warning says how little the audit met.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import cut, table
from grainledger.llm.components import components
from grainledger.llm.vectors import fit_cells, matrix, unit, usable

OVERLAP, SHARD, BLOCK = 3, 1_500, 3_000
#: Neighbours of a node, near and chance candidates, the pruning factor, and the beam of a search.
DEGREE, NEAR, CHANCE, ALPHA, BEAM = 32, 48, 16, 1.2, 48
#: Nodes this far below the threshold are still expanded; vectors audited at first, and the share of links to be found.
LEEWAY, AUDITED, RECALL = 0.1, 64, 0.97
#: Audited vectors with links, vectors audited at once and in all at most; searches, each twice as wide as the one before.
LINKED, AUDIT_BLOCK, AUDIT_MOST, TRIES = 64, 4_096, 16_384, 6
_FOUND = "a long, b long, n long"


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (rows, -1: none) those kept, nearest first, -1 to fill."""
    out = np.full((len(nodes), degree), -1, np.int64)
    for at in range(0, len(nodes), 256):
        own, cand = nodes[at : at + 256], candidates[at : at + 256]
        y = x[np.maximum(cand, 0)]
        to_node = 1 - np.einsum("bcd,bd->bc", y, x[own])
        to_node[(cand < 0) | (cand == own[:, None])] = np.inf
        order = np.argsort(to_node, axis=1, kind="stable")
        cand, to_node = np.take_along_axis(cand, order, 1), np.take_along_axis(to_node, order, 1)
        y = np.take_along_axis(y, order[:, :, None], 1)
        between = 1 - np.einsum("bcd,bed->bce", y, y)
        alive, rows = np.isfinite(to_node), np.arange(len(own))
        for j in range(degree):
            first = alive.argmax(1)
            there = alive[rows, first]
            if not there.any():
                break
            out[at + rows[there], j] = cand[rows[there], first[there]]
            # distances here are squared ones, so the factor is too
            alive &= ~(there[:, None] & (alpha * alpha * between[rows, first] <= to_node))
            alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Neighbours of each row of unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    candidates = np.full((n, NEAR + CHANCE), -1, np.int64)
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        if near:
            candidates[at : at + 512, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    if n > 1:
        candidates[:, NEAR:] = rng.integers(0, n, (n, CHANCE))
    graph = robust_prune(x, np.arange(n), candidates, DEGREE, ALPHA)
    # edges back, and once more pruning
    a, b = np.nonzero(graph >= 0)
    back = pd.DataFrame({"to": graph[a, b], "from": a})
    back = back.iloc[rng.permutation(len(back))].groupby("to")["from"].agg(list)
    both = np.full((n, 2 * DEGREE), -1, np.int64)
    both[:, :DEGREE] = graph
    for node, list_ in back.items():
        both[node, DEGREE : DEGREE + min(DEGREE, len(list_))] = list_[:DEGREE]
    return robust_prune(x, np.arange(n), both, DEGREE, ALPHA)


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of queries, rows) with an inner product of at least ``least``, in runs of queries."""
    n, width = len(x), graph.shape[1]
    medoid = int(np.argmax(x @ x.mean(0)))
    beam = min(beam, n)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        m = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, medoid] = seen[:, n] = True
        ids = np.full((len(q), beam), n)
        ids[:, 0] = medoid
        sims = np.full((len(q), beam), -3.0)
        sims[:, 0] = q @ x[medoid]
        done = ids == n
        while not done.all():
            best = np.where(done, -4.0, sims).argmax(1)
            live = ~done[m, best]
            done[m, best] = True
            next_ = graph[np.where(live, ids[m, best], 0)]
            next_ = np.where(live[:, None] & (next_ >= 0), next_, n)
            next_ = np.where(seen[m[:, None], next_], n, next_)
            seen[m[:, None], next_] = True
            s = np.where(next_ < n, np.einsum("qwd,qd->qw", x[np.minimum(next_, n - 1)], q), -3.0)
            ids, sims, done = np.hstack([ids, next_]), np.hstack([sims, s]), np.hstack([done, next_ == n])
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (ids, sims, done))
        # from what is in range on to all that hangs together with it
        rows, columns = np.nonzero((sims >= least - LEEWAY) & (ids < n))
        front_q, front = rows, ids[rows, columns]
        hits = [(front_q, front)]
        reached = np.zeros((len(q), n + 1), bool)
        reached[front_q, front] = True
        reached[:, n] = True
        while len(front):
            nq, nx = [], []
            for low in range(0, len(front), 1 << 15):
                fq, next_ = np.repeat(front_q[low : low + (1 << 15)], width), graph[front[low : low + (1 << 15)]].ravel()
                next_ = np.where(next_ < 0, n, next_)
                new = ~reached[fq, next_]
                key = np.unique(fq[new] * (n + 1) + next_[new])
                fq, next_ = key // (n + 1), key % (n + 1)
                reached[fq, next_] = True
                near = np.einsum("id,id->i", x[next_], q[fq]) >= least - LEEWAY if len(fq) else np.zeros(0, bool)
                nq.append(fq[near])
                nx.append(next_[near])
            front_q, front = np.concatenate(nq), np.concatenate(nx)
            hits.append((front_q, front))
        yield np.concatenate([h[0] for h in hits]) + at, np.concatenate([h[1] for h in hits])


def _links(base: DataFrame, count: int, least: float, overlap: int, beam: int) -> DataFrame:
    """Of the rows (vec_id, vec, copies) two kinds of rows, verified. a < b or a > b, n = 0: links that join all that are
    linked, about one for a vector. a = b, n: how many others were found to be linked with it, copies counted.

    Pairs themselves stay in their task, so that what goes out follows the vectors, not the pairs of a dense group.
    """
    cells, _ = fit_cells(base, count, count // SHARD, 7)
    shared = base.sparkSession.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = shared.value.nearest(unit(matrix(batch.column("vec"))).astype(np.float32), overlap)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(dict.fromkeys(v)) for v in near.tolist()], pa.list_(pa.int64()))], names=["vec_id", "vec", "copies", "shards"])

    dealt = cut(base.select("vec_id", "vec", "copies").mapInArrow(deal, "vec_id long, vec array<double>, copies long, shards array<long>"))
    member = dealt.select("vec_id", "vec", "copies", F.posexplode("shards").alias("turn", "shard"))
    sizes = member.groupBy("shard").count().collect()  # a row for each cell at most
    blocks = np.ones(len(cells.all), np.int64)
    for r in sizes:
        blocks[r["shard"]] = -(-r["count"] // BLOCK)
    many = F.broadcast(base.sparkSession.createDataFrame([(int(i), int(b)) for i, b in enumerate(blocks)], "shard long, blocks long"))
    member = member.join(many, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        ids, x = frame["vec_id"].to_numpy(), unit(np.stack(frame["vec"].to_numpy())).astype(np.float32)
        graph = build_graph(x)
        return pd.DataFrame({"vec_id": ids, "near": [ids[g[g >= 0]] for g in graph]})

    built = member.groupBy("shard", "block").applyInPandas(build, "vec_id long, near array<long>")
    # a node has at most overlap * DEGREE neighbours
    united = built.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = member.select("shard", "block", "vec_id", "vec", "copies").join(united, "vec_id")
    asked = member.where("turn = 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("shard", "block", "vec_id", "vec").toDF("q_shard", "q_block", "q_id", "q_vec")

    def search(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        held, queries = held.sort_values("vec_id"), queries.sort_values("q_id")
        ids, asked_ids, copies = held["vec_id"].to_numpy(), queries["q_id"].to_numpy(), held["copies"].to_numpy()
        exact, q = unit(np.stack(held["vec"].to_numpy())), unit(np.stack(queries["q_vec"].to_numpy()))
        width = max(len(v) for v in held["near"])
        graph = np.full((len(ids), max(1, width)), -1, np.int64)
        for i, v in enumerate(held["near"]):
            at = np.searchsorted(ids, v)
            own = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == v)
            graph[i, : own.sum()] = at[own]
        x, n, joined, out = exact.astype(np.float32), np.zeros(len(q), np.int64), np.arange(len(ids)), []
        for a, b in range_search(x, graph, q.astype(np.float32), least, beam):
            # one query's links at a time
            order = np.argsort(a, kind="stable")
            some, starts = np.unique(a[order], return_index=True)
            for i, rows in zip(some.tolist(), np.split(b[order], starts[1:])):
                rows = np.unique(rows)
                rows = rows[(exact[rows] @ q[i] >= least) & (ids[rows] != asked_ids[i])]
                n[i] += copies[rows].sum()
                # a link to one of each set of vectors that aren't joined yet
                sets, first = np.unique(joined[rows], return_index=True)
                out.extend((asked_ids[i], ids[j], 0) for j in rows[first].tolist())
                if len(sets) > 1:
                    joined[np.isin(joined, sets)] = sets[0]
        out.extend((i, i, m) for i, m in zip(asked_ids[n > 0].tolist(), n[n > 0].tolist()))
        return pd.DataFrame(out, columns=["a", "b", "n"])

    return nodes.groupBy("shard", "block").cogroup(asked.groupBy("q_shard", "q_block")).applyInPandas(search, _FOUND)


def _audited(base: DataFrame, count: int, least: float) -> tuple[DataFrame, int, int]:
    """(links of audited vectors: own, n; vectors audited; those with links), found by comparison with all rows."""
    spark = base.sparkSession
    order = base.select("vec_id", "vec").orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id")
    true, audited, linked, size = None, 0, 0, AUDITED
    while audited < min(count, AUDIT_MOST) and linked < LINKED:
        some = order.offset(audited).limit(min(size, AUDIT_MOST - audited)).collect()
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in some]), unit(np.array([r["vec"] for r in some]))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            n = np.zeros(len(ids), np.int64)
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part = batch.slice(at, 4096)
                    near = unit(matrix(part.column("vec"))) @ q.T >= least
                    near &= part.column("vec_id").to_numpy()[:, None] != ids[None, :]
                    n += part.column("copies").to_numpy() @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["own", "n"])

        met = cut(base.select("vec_id", "vec", "copies").mapInArrow(run, "own long, n long").groupBy("own").agg(F.sum("n").alias("n")))
        true = met if true is None else true.union(met)
        audited, linked, size = audited + len(some), linked + met.count(), min(4 * size, AUDIT_BLOCK)
    return true, audited, linked


def _recall(true: DataFrame, found: DataFrame) -> float:
    """Average share of an audited vector's links that were found; 1 where none has any."""
    met = true.join(found.where("a = b").groupBy(F.col("a").alias("own")).agg(F.sum("n").alias("met")), "own", "left")
    share = met.select((F.coalesce("met", F.lit(0)) / F.col("n")).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def near_duplicate_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (columns vec_id and embedding).

    Rows that ``usable`` leaves out have no links and are components of their own; a null id has a null component and is
    kept. Rows that repeat an id are one vector, the first by value, and each gets that result. Equal vectors are linked
    with one another without being compared pair by pair. ``n_links`` counts what the search from the vector itself found.
    An empty table gives no rows. A search that the audit finds incomplete at its widest is a RuntimeError; the share of
    links found is logged.
    """
    own = usable(rows).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    own = cut(own)
    classes = cut(own.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    count = classes.count()
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not count:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    true, audited, linked = _audited(classes, count, least)
    sure = linked >= LINKED or audited >= count
    for turn in range(TRIES):
        overlap, beam = OVERLAP << turn, BEAM << turn
        found = cut(_links(classes, count, least, overlap, beam))
        recall = _recall(true, found)
        logging.getLogger(__name__).info("%.4f of the links of %d vectors found, with overlap %d and beam %d", recall, linked, overlap, beam)
        if recall >= RECALL and (sure or turn):
            break
    else:
        raise RuntimeError(f"links found of {linked} audited vectors that have any: {recall:.4f}, less than {RECALL}, with overlap {overlap} and beam {beam}")
    if not sure:
        warnings.warn(f"only {linked} of {audited} audited vectors have links, too few to tell what share of links was found", stacklevel=2)
    counted = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = components(found.where("a != b").select("a", "b")).withColumnRenamed("id", "rep")
    of_class = classes.withColumnRenamed("vec_id", "rep").join(counted, "rep", "left").join(joined, "rep", "left")
    of_class = of_class.select("vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    got = own.join(of_class, "vec").select("vec_id", "n_links", "component")
    out = out.join(got, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
