"""What the two operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of the sample that the upper cells are fitted on, about; cells that one level has at most; vectors for each
#: cell of the lower level, and of one task that fits them.
SAMPLE, FLAT, EACH, FIT = 20_000, 1_024, 32, 50_000


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", length: int | None = None) -> DataFrame:
    """(vec_id long, vec array<double>) of the rows that take part.

    Left out: null ids, vectors that are null, empty or all zero, that hold a null or a component that isn't finite,
    and those of another length than the one given, or else than the most frequent one.
    """
    v = F.transform(vector_column, lambda x: x.cast("double"))
    got = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    got = got.where(fine & F.exists("vec", lambda x: x != 0))
    if length is None:
        most = got.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = most["d"] if most else 0
    return got.where(F.size("vec") == length)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """Centroids, in one level, or grouped by the cells of an upper one."""

    def __init__(self, upper: np.ndarray, lower: np.ndarray | None = None, of: np.ndarray | None = None):
        order = np.argsort(of, kind="stable") if of is not None else None
        self.upper, self.flat = upper, lower is None
        self.all = upper if lower is None else lower[order]
        self.cuts = None if lower is None else np.searchsorted(of[order], np.arange(len(upper) + 1))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest centroids of each row, nearest first; with two levels those in the nearest upper cells,
        twice as many as asked for."""
        if self.flat:
            return nearest(x, self.all, n)
        n, tops = min(n, len(self.all)), nearest(x, self.upper, 2 * n + 2)
        ids, far = np.zeros((len(x), tops.shape[1] * n), np.int64), np.full((len(x), tops.shape[1] * n), np.inf)
        for j in range(tops.shape[1]):
            order = np.argsort(tops[:, j], kind="stable")
            top, starts = np.unique(tops[order, j], return_index=True)
            for t, a, b in zip(top, starts, np.append(starts[1:], len(order))):
                low, high = self.cuts[t], self.cuts[t + 1]
                if low < high:
                    rows, c = order[a:b], self.all[low:high]
                    own = nearest(x[rows], c, n)
                    ids[rows, j * n : j * n + own.shape[1]] = own + low
                    far[rows[:, None], j * n + np.arange(own.shape[1])] = (c * c).sum(1)[own] - 2 * np.einsum("id,ijd->ij", x[rows], c[own])
        best = np.argsort(far, axis=1, kind="stable")[:, :n]
        got, known = np.take_along_axis(ids, best, 1), np.isfinite(np.take_along_axis(far, best, 1))
        return np.where(known, got, got[:, :1])


def fit_cells(rows: DataFrame, count: int, wanted: int, seed: int) -> tuple[Cells, np.ndarray]:
    """(about as many cells as wanted, a sample of unit vectors) of rows vec_id, vec.

    Up to ``FLAT`` cells are fitted on the sample. More are fitted in tasks: upper cells, about the square root of their
    number, part the rows, and each part's own come from ``EACH`` vectors for a cell, ``FIT`` at a time. What passes the
    driver are the sample and the cells.
    """
    x = sample(rows, count, SAMPLE, seed)
    if not len(x):
        x = unit(np.array([r["vec"] for r in rows.limit(100).collect()], np.float32))
    if wanted <= FLAT:
        return Cells(k_means(x, max(1, wanted), spherical=True)), x
    upper = k_means(x, round(wanted**0.5), spherical=True)
    rate = min(1.0, EACH * wanted / count)
    per = rate * count / wanted
    shared = rows.sparkSession.sparkContext.broadcast(upper)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = unit(matrix(batch.column("vec"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest(own, shared.value, 1)[:, 0]), pa.array([v.tobytes() for v in own], pa.binary())], names=["vec_id", "part", "vec"])

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = np.stack([np.frombuffer(v, np.float32) for v in frame.sort_values("vec_id")["vec"]])
        return pd.DataFrame({"part": key[0], "cell": [c.tobytes() for c in k_means(own, max(1, round(len(own) / per)), spherical=True)]})

    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(1 << 20)) < (1 << 20) * rate).select("vec_id", "vec")
    dealt = some.mapInArrow(deal, "vec_id long, part long, vec binary")
    sizes = dealt.groupBy("part").agg(F.ceil(F.count("*") / FIT).alias("runs"))  # a row for each upper cell at most
    dealt = dealt.join(F.broadcast(sizes), "part").withColumn("run", F.pmod(F.xxhash64("vec_id"), "runs"))
    got = sorted((r["part"], bytes(r["cell"])) for r in dealt.groupBy("part", "run").applyInPandas(fit, "part long, cell binary").collect())
    return Cells(upper, np.stack([np.frombuffer(c, np.float32) for _, c in got]), np.array([p for p, _ in got])), x


def sample(rows: DataFrame, count: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` unit vectors at most, chosen by a hash of the id, in order of id."""
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, most / max(count, 1)))
    got = sorted((r["vec_id"], r["vec"]) for r in some.collect())
    x = np.array([v for _, v in got], np.float32)
    return unit(x) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1, spherical: bool = False) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
        if spherical:
            c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
        c = c.astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first."""
    far = (c * c).sum(1)[None, :] - 2 * x @ c.T
    n = min(n, len(c))
    best = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
