"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language give one matrix of log probabilities, ``buckets`` by languages, which is
broadcast; its size depends on these two alone. Texts are scored in batches: the n-grams of a batch are hashed as
arrays, their rows of the matrix looked up, and summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import remainder, table
from grainledger.llm.token_ids import give_back, let_go

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
#: Learning rows of one language at most, chosen by a hash of the id.
LEARN_ROWS = 8_000
UNKNOWN = "und"
#: Languages at most, else an error: the matrix then has 128 MB.
LANGUAGES = 1_000

_tables: dict[str, np.ndarray] = {}


def _letters(codes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many code points whether it is a letter, and its lower case."""
    if len(_tables.get("letter", ())) < codes:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(codes)), bool, codes)
        _tables["lower"] = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(codes)), np.uint32, codes)
    return _tables["letter"], _tables["lower"]


def grams(texts: list[str], n: int, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of 1 to n: hashed n-grams around the texts' letters, and the number of the text of each."""
    raw = np.frombuffer(("   " + "   ".join(texts) + "   ").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = 0x10000 if raw.max() < 0x10000 else 0x110000
    letter, lower = (x[:codes] for x in _letters(codes))
    narrow = raw.astype(np.uint16) if len(letter) == 0x10000 else raw
    is_letter = letter[narrow]
    code = np.where(is_letter, lower[narrow], np.uint32(32))
    at = np.flatnonzero(is_letter)
    ends = np.cumsum([len(t) + 3 for t in texts])
    text = np.searchsorted(ends, at - 3, side="right")
    code = code * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    yield ((code[at] + np.uint32(1)) * np.uint32(0x85EBCA6B)) >> shift, text
    for k in range(2, n + 1):
        h = np.full(len(at), np.uint32(k))
        for j in range(k):
            h = (h ^ code[at + j - (k - 1) // 2]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        yield (h * np.uint32(0xC2B2AE35)) >> shift, text


def _batches(batches: Iterator[pa.RecordBatch], chars: int = 400_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about so many characters at most, or one row, with their texts (column ``text``)."""
    let_go()
    for batch in batches:
        low, texts, total = 0, [], 0
        for i in range(len(batch)):
            texts.append(batch.column("text")[i].as_py() or "")
            total += len(texts[-1])
            if total >= chars or i == len(batch) - 1:
                yield batch.slice(low, i + 1 - low), texts
                low, texts, total = i + 1, [], 0
    give_back()


def learn(rows: DataFrame, n: int = max(GRAMS), buckets: int = BUCKETS, most: int = LEARN_ROWS, smooth: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities) from columns doc_id, text, lang; ``lang`` not null.

    ``most`` bounds the learning rows of a language, about: a hash of the id chooses them, so rows that repeat an id or
    have none go together. Priors come from all rows. A null or empty text adds to the prior alone; without rows there
    are no languages. Other columns are not read.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the matrix that every task holds would be too large")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((buckets, 0), np.float32)
    spark = rows.sparkSession
    rates = spark.createDataFrame([(s, i, min(1.0, most / sizes[s])) for i, s in enumerate(langs)], "lang string, k int, rate double")
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), buckets), np.int64)
        for part, texts in _batches(batches):
            ks = part.column("k").to_numpy()
            for h, text in grams(texts, n, buckets):
                key = ks[text] * buckets + h
                at, c = np.unique(key, return_counts=True)
                total.ravel()[at] += c
        size = buckets // 16
        rows = [(k, j, total[k, j * size : (j + 1) * size].tobytes()) for k in range(len(langs)) if total[k].any() for j in range(16)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["k", "part", "counts"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in frame["counts"])
        return pd.DataFrame({"k": [key[0]], "part": [key[1]], "counts": [total.tobytes()]})

    schema = "k int, part int, counts binary"
    counted = chosen.select("k", "text").mapInArrow(count, schema).groupBy("k", "part").applyInPandas(add, schema)
    total = np.zeros((len(langs), 16, buckets // 16), np.int64)
    for r in counted.toLocalIterator():
        total[r["k"], r["part"]] = np.frombuffer(r["counts"], np.int64)
    total = total.reshape(len(langs), buckets) + smooth
    return langs, np.log(np.array([sizes[s] for s in langs]) / sum(sizes.values())), np.log(total / total.sum(1, keepdims=True)).T.astype(np.float32).copy()


def predict(docs: DataFrame, langs: list[str], prior: np.ndarray, matrix: np.ndarray, n: int = max(GRAMS), keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score, the posterior probability of that language, of each document; then the columns
    named by ``keep``, none of which may be called like a result (``set_aside`` renames them).

    Texts that are null or have no letter, and all texts where nothing was learned, get ``und`` and 0. Ties go to
    the language first in code-point order. Null ids are kept and repeated rows each get a row.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, prior, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = model.value
        columns = np.ascontiguousarray(matrix.T)
        for part, texts in _batches(batches):
            total, letters = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
            for h, text in grams(texts, n, matrix.shape[0]):
                starts = np.flatnonzero(np.diff(text, prepend=-1))
                if not len(starts):
                    break
                which = text[starts]
                letters[which] = np.diff(np.append(starts, len(text)))
                for k in range(len(langs)):
                    total[which, k] += np.add.reduceat(columns[k][h].astype(np.float64), starts)
            if langs:
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            known = (letters > 0) & bool(langs)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("own_id"),
                    pa.array([langs[best[i]] if known[i] else UNKNOWN for i in range(len(texts))], pa.string()),
                    pa.array([float(share[i]) if known[i] else 0.0 for i in range(len(texts))], pa.float64()),
                    *[part.column(f"own_{c}") for c in keep],
                ],
                names=["own_id", "lang_pred", "score", *[f"own_{c}" for c in keep]],
            )

    keep = keep or []
    kinds = "".join(f", `own_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    read = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text", *[F.col(c).alias(f"own_{c}") for c in keep])
    got = read.mapInArrow(score, f"own_id long, lang_pred string, score double{kinds}")
    return got.select(F.col("own_id").alias("doc_id"), "lang_pred", "score", *[F.col(f"own_{c}").alias(c) for c in keep if c != "doc_id"])


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that are learned from: language known, and the id's crc32 modulo 4 isn't 2."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return docs.where(F.col("lang").isNotNull() & ~held).select("doc_id", "text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, *learn(learning_rows(docs)))
    return got.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
