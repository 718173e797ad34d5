"""What several corpus operators share: columns set aside, words and vectorised hashes; and where they find cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.session import cut, shared_folder

__all__ = ["cut", "shared_folder"]

#: A word, for Spark's and for Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper-case ASCII letters to lower case; other letters stay.
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(docs with each column but those needed under a name that no operator uses, what gives a result docs' columns)."""
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    names = {c: c if c in needed else f"aside_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(quoted[c]).alias(names[c]) for c in docs.columns])
    return plain, lambda got: got.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(df, written to the shared folder as Parquet and read again; what deletes it). For what is large and needed for a while only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True) and None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_for(df: DataFrame, text: str, each: int) -> tuple[int, int]:
    """(number of parts that hold about ``each`` bytes of text, rows): one cheap pass over one column."""
    got = df.agg(F.sum(F.octet_length(text) + 16).alias("b"), F.count("*").alias("n")).first()
    return max(1, -(-(got["b"] or 0) // each)), got["n"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number modulo 2**64, and of its inverse."""
    if len(_powers["up"]) <= n:
        m = max(n + 1, 1 << 16)
        for k, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words in UTF-8 bytes."""
    edge = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[0::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, chunk: int = 1 << 19) -> np.ndarray:
    """64-bit hash of each word: equal words have equal hashes wherever they stand.

    Works through about ``chunk`` bytes at a time, so that its memory doesn't follow the text's length.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        part, a, b = raw[low:high], starts[at:to] - low, ends[at:to] - low
        up, down = _power(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part] if lower else part] * up[: high - low], out=total[1:])
        out[at:to] = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of each run of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(salt * 0x632BE59BD9B4E019 + n & 0xFFFFFFFFFFFFFFFF))
    for j in range(n):
        out = (out ^ words[j : j + m]) * _ODD
        out ^= out >> np.uint64(29)
    return mix64(out)
