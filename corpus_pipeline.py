"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. Columns beside doc_id, text, lang,
source and n_chars are passed on, whatever their names; an empty table gives an empty one. A stage bounds
the session's batches and row groups in bytes or rows (``session.small_batches``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import cut, set_aside, shared_folder
from grainledger.llm.language_id import UNKNOWN, learn, learning_rows, predict
from grainledger.llm.minhash import near_duplicates, text_digest
from grainledger.llm.mixing import mixed
from grainledger.llm.packing import pack
from grainledger.llm.substrings import remove_repeats
from grainledger.session import small_batches

#: A language must be at least this probable for a document to stay.
LEAST_PROBABLE = 0.5
#: Ids that are sent to every task at most, about 16 MB.
BROADCAST_IDS = 1_000_000
#: Units that packing's encoder remembers here, where workers live beside a JVM that four stages have filled.
REMEMBER_UNITS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay: those without a letter go, and those of which no language is likely.

    A null or empty text goes. Null ids stay, repeated rows each do; with nothing to learn from no row stays.
    """
    small_batches(spark)
    plain, back = set_aside(docs, "doc_id", "text")
    got = predict(plain, *learn(learning_rows(docs)), keep=[c for c in plain.columns if c != "doc_id"])
    return back(got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_PROBABLE)))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Rows with a null id, and texts without words, are duplicates of none and stay. Rows that repeat an id stay or go
    together if their texts have the same words; else each is a document of its own.
    """
    small_batches(spark)
    gone = cut(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), "own_text").distinct())
    # few ids go to every task, so that texts aren't shuffled; more meet them in a join
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    plain, back = set_aside(docs, "doc_id", "text")
    this = (F.col("doc_id") == F.col("gone_id")) & (F.col("own_text").isNull() | (F.col("own_text") == text_digest()))
    return back(plain.join(gone, this, "left_anti"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are taken out of the texts; n_chars is counted anew.

    All rows stay, also those left without words. A null text stays null; a null id comes after all others, and
    rows that repeat an id don't repeat each other.
    """
    small_batches(spark)
    plain, back = set_aside(docs, "doc_id", "text", "n_chars")
    got = remove_repeats(plain, keep=[c for c in plain.columns if c not in ("doc_id", "text")], texts=True).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast("long"))
    return back(got)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shards that are each in shuffled order.

    Null and empty texts have no words and are never drawn. Null sources are one source, null ids are ids like others,
    repeated rows are documents of their own.
    """
    small_batches(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null or empty text is its end id alone, a null id is kept."""
    small_batches(spark)
    return pack(docs, remember=REMEMBER_UNITS, together=256)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", source_mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the draws; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # nothing reads it any more
                files, root = fs.FileSystem.from_uri(f"{folder}/{k - 1}" if "://" in folder else f"file://{folder}/{k - 1}")
                files.delete_dir(root)
    return docs
