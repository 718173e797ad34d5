"""Quality scores by Bradley-Terry ranking of document pairs.

A pair is a document labelled good and one labelled bad: the first is preferred. The probability of that is the
logistic function of the difference of the two documents' worths, and a worth is linear in features of the text, so
the weights come from logistic loss on feature differences. The share of bad labels then names a quantile of the
worths; the score is the logistic function of the worth above that quantile.

Features read characters, words and lines of the whole text, never labels, language, source or id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import cut, mix64, remainder, table, word_hashes, word_spans
from grainledger.llm.turns import numbered

#: Opponents, in the pairs, of each document of the more frequent label.
OPPONENTS = 8
PLAIN = 13
FEATURES = 2 * PLAIN

_KIND = np.full(256, 4, np.uint8)  # 0 white space, 1 lower-case or other letter, 2 upper-case, 3 digit, 4 sign, 5 inside a character
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[192:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:192] = 5


def features(texts: list[str]) -> np.ndarray:
    """A row of PLAIN numbers for each text; an empty text has zeros."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])
    cut = np.concatenate(([0], ends))
    kind = _KIND[raw]

    def by_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[cut])

    space, lower, upper, digit, sign = (by_text(kind == k).astype(float) for k in range(5))
    chars = np.maximum(space + lower + upper + digit + sign, 1)
    starts, stops = word_spans(raw)
    words = word_hashes(raw, starts, stops)
    of = np.searchsorted(ends, starts, side="right")
    n = np.bincount(of, minlength=len(texts)).astype(float)
    some = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=len(texts)) / some

    letters = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2))))
    lettered = letters[stops] > letters[starts]
    tail = (kind[stops - 1] == 4) & (kind[np.maximum(stops - 2, 0)] == 4) & (stops - starts > 2)
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (of[1:] == of[:-1]))) if len(words) else np.zeros(0, bool)
    distinct = np.bincount(np.searchsorted(ends, starts[np.unique(words ^ mix64(of.astype(np.uint64)), return_index=True)[1]], side="right"), minlength=len(texts)) if len(words) else np.zeros(len(texts))
    breaks = np.flatnonzero(raw == 10)
    line_from = np.concatenate(([0], breaks[:-1] + 1))
    full = breaks > line_from
    line_from, line_to = line_from[full], breaks[full]
    lines = word_hashes(raw, line_from, line_to)
    line_of = np.searchsorted(ends, line_from, side="right")
    n_lines = np.bincount(line_of, minlength=len(texts)).astype(float)
    first = np.unique(lines ^ mix64(line_of.astype(np.uint64)), return_index=True)[1]
    once = np.bincount(line_of[first], minlength=len(texts))
    return np.column_stack([
        (lower + upper) / chars, upper / np.maximum(lower + upper, 1), digit / chars, sign / chars, space / chars,
        share(~lettered), share(tail), share(again), 1 - distinct / some, 1 - once / np.maximum(n_lines, 1),
        np.log1p(n), np.log1p(n_lines), (chars - space) / some / 10,
    ]) * (n > 0)[:, None]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of about 400,000 characters at most, or one text, with their features."""
    for batch in batches:
        low, size = 0, 0
        texts = []
        for i in range(len(batch)):
            texts.append(batch.column("text")[i].as_py() or "")
            size += len(texts[-1])
            if size > 400_000 or i == len(batch) - 1:
                yield batch.slice(low, i + 1 - low), features(texts)
                low, size, texts = i + 1, 0, []


class Model:
    """Weights on standardised features and their squares; the threshold is a quantile of training worths."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray):
        self.middle, self.spread = middle, spread
        self.weights, self.threshold = np.zeros(FEATURES), 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -5, 5)
        return np.hstack([z, z * z])

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.threshold, -30, 30)))

    def loss(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Sums over pairs: of what the logistic loss curves by, row after row, then of its slope."""
        d = self.expand(good) - self.expand(bad)
        p = 1 / (1 + np.exp(-np.clip(d @ self.weights, -30, 30)))
        return np.concatenate((((d * (p * (1 - p))[:, None]).T @ d).ravel(), d.T @ (1 - p)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, PLAIN)


def _totals(rows: DataFrame, f: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """Sum of f over the rows' columns, all of features: a row for each task comes to the driver, and they are added in the tasks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += f(*map(_matrix, batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["part", "total"])

    return sum((np.array(r["total"]) for r in sorted(rows.mapInArrow(run, "part int, total array<double>").collect())), np.zeros(size))


def _pairs(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """good, bad: every row of the more frequent label with OPPONENTS of the other, all of which are met; ``rows`` have places by a hash."""
    many, few = (1, 0) if sizes[1] >= sizes[0] else (0, 1)
    own = rows.where(F.col("quality") == many).select(F.col("x").alias("own"), F.explode(F.sequence(F.col("pos") * OPPONENTS, F.col("pos") * OPPONENTS + OPPONENTS - 1)).alias("n"))
    others = rows.where(F.col("quality") == few).select(F.col("x").alias("other"), "pos")
    met = own.withColumn("at", F.col("n") % sizes[few]).join(others, F.col("at") == F.col("pos"))
    return met.select(F.col("own" if many else "other").alias("good"), F.col("other" if many else "own").alias("bad"))


def learn(docs: DataFrame, labels: DataFrame, penalty: float = 1e-3) -> Model:
    """From all texts of documents with a label (columns doc_id, quality; rows with nulls are left out).

    Only features are shuffled and stored, never texts. Rows of either label are dealt by a hash, and each meets opponents
    of the other; each round of Newton's method sums over the pairs in tasks. The quantile of the worths is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _run(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    marks = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")
    rows = numbered(read.join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id", "x")), "quality", ["h", "doc_id"])
    sizes = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    n = sizes[0] + sizes[1]
    if not n:
        return Model(np.zeros(PLAIN), np.ones(PLAIN))
    x = rows.select("x")
    middle = _totals(x, lambda v: v.sum(0), PLAIN) / n
    model = Model(middle, np.sqrt(_totals(x, lambda v: ((v - middle) ** 2).sum(0), PLAIN) / n) + 1e-3)
    if not sizes[0] or not sizes[1]:
        model.threshold = -4.0 if sizes[1] else 4.0
        return model
    pairs, count = cut(_pairs(rows, sizes)), max(sizes.values()) * OPPONENTS
    for _ in range(25):  # Newton's method
        got = _totals(pairs, model.loss, FEATURES * (FEATURES + 1)) / count
        step = np.linalg.solve(got[: FEATURES**2].reshape(FEATURES, FEATURES) + penalty * np.eye(FEATURES), got[FEATURES**2 :] - penalty * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(batch), np.int32)), pa.array(model.worth(_matrix(batch.column(0))))], names=["all", "worth"])

    place = min(sizes[0] - 1, n - 2)
    edge = numbered(x.mapInArrow(worths, "all int, worth double"), "all", ["worth"]).where(F.col("pos").between(place, place + 1)).collect()  # two rows
    model.threshold = float(sum(r["worth"] for r in edge)) / 2
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each document; null and empty texts have all features 0.

    Null ids are kept, repeated rows each get a row, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _run(batches):
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    got = quality_scores(docs, learn(docs.where(~held), labels.where(~held)))
    return got.select("doc_id", held.alias("held_out"), "score", "predicted")
