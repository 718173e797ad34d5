"""What a Python worker is given at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainledger.llm import language_id, minhash, substrings, token_ids
from grainledger.session import BATCH_BYTES, SMALL

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["b"])

    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 500).alias("text"))
    return docs.mapInArrow(sizes, "b long").agg(F.max("b")).first()[0]


def test_a_stage_bounds_what_a_worker_is_given(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.getAll.get(KEY)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(KEY)
            stage(spark, docs, "")
            assert _largest(spark) <= 1.5 * BATCH_BYTES
        spark.conf.set(KEY, "12345678")
        corpus_pipeline.packing(spark, docs, "")
        assert spark.conf.get(KEY) == "12345678"
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)


def test_a_stage_bounds_vectors_and_row_groups(spark):
    before = {k: spark.conf.getAll.get(k) for k in SMALL}
    try:
        for k in SMALL:
            spark.conf.unset(k)
        spark.conf.set("parquet.block.size", "12345678")
        corpus_pipeline.source_mixing(spark, spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"), "")
        assert {k: spark.conf.get(k) for k in SMALL} == SMALL | {"parquet.block.size": "12345678"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.mark.parametrize("module, task", [
    (language_id, lambda docs: list(language_id._batches(iter(docs.to_batches())))),
    (minhash, lambda docs: list(minhash._text_rows(iter(docs.to_batches())))),
    (substrings, lambda docs: substrings._then_give_back(lambda a, b: a)(docs, docs)),
])
def test_a_task_gives_back_what_it_freed(module, task, monkeypatch):
    back = []
    monkeypatch.setattr(module, "give_back", lambda: back.append(1))
    task(pa.table({"doc_id": pa.array([1]), "text": ["a b"]}))
    assert back == [1]
    token_ids.give_back()
