"""Approximate nearest neighbours: inverted lists with product-quantised residuals, and exact reranking.

There are as many lists as the square root of the rows; coarse centroids and the codebooks of the residuals come from
samples that ``fit_cells`` states; every row is indexed. A query reads
the lists whose centroids are nearest. In a list it looks up, for each code, the product of its own part and the
code's centroid in a table that it makes once (the asymmetric distance), and reranks on the original vectors those
rows that could by this estimate and its error be among the nearest. How many lists are read is set by an audit:
for a bounded number of queries the true neighbours are found by comparing with all rows, and enough lists are read
to meet nearly all of them. Where the nearest lists together hold too few rows for the query's neighbours, lists are first
read on until there are enough, and then as many more.

Lists are dealt into parts in blocks of a bounded number of rows, so that a list with very many rows is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.llm.common import cut, mix64, table
from grainledger.llm.vectors import Cells, fit_cells, k_means, matrix, nearest, unit, usable

SUBSPACES, CODES = 16, 256
#: Rows of a block of a list, and of a part of the index, about.
BLOCK, PART = 2_048, 4_096
#: Audited queries; of their true neighbours this share must stand in lists that are read.
AUDITED, SHARE = 128, 0.98
#: Rows are reranked whose estimate, raised by so many standard errors, reaches the nearest known so far.
ERRORS = 2.5


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision; scaled first, so that no square overflows."""
    return unit(x) @ unit(q[None, :])[0]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _true_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For a bounded number of queries the nearest rows of all (their vectors)."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            s = unit(x) @ unit(queries).T
            s[own[:, None] == ids[None, :]] = -2
            top = np.argsort(-s, axis=0)[:k].T
            for j, t in enumerate(top):
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(t)), pa.array(s[t, j]), pa.array(list(x[t]), pa.list_(pa.float64()))], names=["j", "s", "vec"])

    w = W.partitionBy("j").orderBy(F.desc("s"))
    got = rows.select("vec_id", "vec").mapInArrow(run, "j long, s double, vec array<double>").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    out: list[list] = [[] for _ in ids]
    for r in got.collect():
        if r["s"] > -2:
            out[r["j"]].append(r["vec"])
    return [np.array(v).reshape(len(v), -1) for v in out]


class _Index:
    def __init__(self, cells: Cells, books: np.ndarray, parts: int):
        self.cells, self.coarse, self.books, self.parts = cells, cells.all, books, parts
        self.blocks, self.sizes = np.ones(len(cells.all), np.int64), np.zeros(len(cells.all), np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of what the codes miss, of unit vectors."""
        list_ = self.cells.nearest(x, 1)[:, 0]
        rest = x - self.coarse[list_]
        codes, missed = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for s, part in enumerate(np.array_split(np.arange(x.shape[1]), len(self.books))):
            book = self.books[s][:, : len(part)]
            codes[:, s] = nearest(rest[:, part], book, 1)[:, 0]
            missed += ((rest[:, part] - book[codes[:, s]]) ** 2).sum(1)
        return list_, codes, np.sqrt(missed)

    def part(self, list_: np.ndarray, block: np.ndarray) -> np.ndarray:
        return (mix64(list_.astype(np.uint64) * np.uint64(1 << 20) + block.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)


def _books(x: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    rest = x - coarse[nearest(x, coarse, 1)[:, 0]]
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    out = np.zeros((len(parts), min(CODES, len(x)), len(parts[0])), np.float32)
    for s, part in enumerate(parts):
        out[s, :, : len(part)] = k_means(rest[:, part], out.shape[1], 8, s)
    return out


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found but itself; ties to the smaller id.

    Both have the columns vec_id and embedding. Rows that ``usable`` leaves out take no part. Rows that repeat an id
    count as one, the first by vector. Queries of another length than the rows' have no neighbours. No rows or queries give
    no rows. With no more than k rows all are found.
    """
    base = cut(usable(rows).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    width = base.select(F.size("vec")).first()
    asked = cut(usable(queries, length=width[0] if width else 0).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    schema = "query_id long, vec_id long, score double"
    spark, count, n_asked = rows.sparkSession, base.count(), asked.count()
    if not count or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells, x = fit_cells(base, count, max(1, round(count**0.5)), 10)
    coarse = cells.all
    index = _Index(cells, _books(x, coarse), max(1, -(-count // PART)))
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = unit(matrix(batch.column("vec"))).astype(np.float32)
                list_, codes, missed = shared.value.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(list_, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)], names=["vec_id", "vec", "list", "codes", "missed"])

    coded = cut(base.mapInArrow(encode, "vec_id long, vec array<double>, list int, codes binary, missed double"))
    for r in coded.groupBy("list").count().collect():  # a row for each list at most
        index.blocks[r["list"]] = -(-r["count"] // BLOCK)
        index.sizes[r["list"]] = r["count"]

    some = asked.orderBy(F.xxhash64("vec_id", F.lit(11))).limit(AUDITED).collect()
    ids, q = np.array([r["vec_id"] for r in some]), np.array([r["vec"] for r in some])
    needed = [0]
    for near, own in zip(_true_neighbours(base, ids, q, k), q):
        if len(near):
            order = np.argsort(-(unit(own[None, :]).astype(np.float32) @ coarse.T)[0], kind="stable")
            needed += np.argsort(order)[cells.nearest(unit(near).astype(np.float32), 1)[:, 0]].tolist()
    probes = int(np.sort(needed)[min(len(needed) - 1, int(SHARE * len(needed)))]) + 1
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_ = batch.column("list").to_numpy()
            block = mix64(batch.column("vec_id").to_numpy().astype(np.uint64)) % shared.value.blocks[list_].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.part(list_, block)), *[batch.column(c) for c in ("vec_id", "vec", "list", "codes", "missed")]], names=["part", "vec_id", "vec", "list", "codes", "missed"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i in range(len(batch)):
                v = batch.column("vec")[i].values.to_numpy()
                order = np.argsort(-(unit(v[None, :]).astype(np.float32) @ index.coarse.T)[0], kind="stable")
                # lists that hold k rows beside the query's own
                full = int(np.searchsorted(np.cumsum(index.sizes[order]), k + 1)) + 1
                lists = order[: probes if full == 1 else full + probes]
                n = index.blocks[lists]
                each = np.repeat(lists, n)
                part = index.part(each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                parts = np.unique(part)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([batch.column("vec_id")[i].as_py()] * len(parts)), pa.array([v] * len(parts), pa.list_(pa.float64())), pa.array([np.unique(each[part == p]) for p in parts], pa.list_(pa.int64()))], names=["part", "query_id", "query", "lists"])

    def search(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = shared.value
        held = held.sort_values("vec_id")
        ids, list_, missed = held["vec_id"].to_numpy(), held["list"].to_numpy(), held["missed"].to_numpy()
        x, codes = np.stack(held["vec"].to_numpy()), np.stack([np.frombuffer(c, np.uint8) for c in held["codes"]])
        split = np.array_split(np.arange(x.shape[1]), len(index.books))
        out = []
        for q_id, q, lists in zip(queries["query_id"], queries["query"], queries["lists"]):
            read = np.zeros(len(index.coarse), bool)
            read[lists] = True
            rows = np.flatnonzero(read[list_] & (ids != q_id))
            if not len(rows):
                continue
            u = unit(q[None, :])[0].astype(np.float32)
            about = (index.coarse @ u)[list_[rows]].astype(float)
            for s, part in enumerate(split):
                about += (index.books[s][:, : len(part)] @ u[part])[codes[rows, s]]
            first = rows[np.argsort(-about, kind="stable")[: 8 * k]]
            score = _exact(q, x[first])
            reach = score[_best(ids[first], score, k)][-1] if len(first) >= k else -2
            also = rows[about + ERRORS * missed[rows] / len(u) ** 0.5 >= reach - 1e-6]
            also = np.union1d(also, first)
            score = _exact(q, x[also])
            best = _best(ids[also], score, k)
            out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[also][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    parts = coded.mapInArrow(place, "part long, vec_id long, vec array<double>, list int, codes binary, missed double")
    wanted = asked.mapInArrow(ask, "part long, query_id long, query array<double>, lists array<long>")
    found = parts.groupBy("part").cogroup(wanted.groupBy("part")).applyInPandas(search, schema)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 50 = 0"))
