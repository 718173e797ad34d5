"""Batches of any size are read as few rows at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from grainledger.functions import vectorised
from grainledger.operators import text


def test_slices_of_one_batch():
    pages = pa.array([None, "<p>a</p>"] * vectorised.SLICE)
    got = list(text.normalise.parts(iter([pages, pages.slice(0, 1), pages.slice(0, 0)])))
    assert [len(x) for x in got] == [vectorised.SLICE, vectorised.SLICE, 1]
    assert pa.chunked_array(got).to_pylist() == [None, "a"] * vectorised.SLICE + [None]


def test_slices_of_replies():
    replies = pa.array([None, [{"type": "text", "text": "## RISK\nclaim: a", "citations": None}]] * vectorised.SLICE)
    got = list(text.claims.parts(iter([replies, replies.slice(0, 1), replies.slice(0, 0)])))
    assert [len(x) for x in got] == [vectorised.SLICE, vectorised.SLICE, 1]
    assert [len(x) for x in pa.chunked_array(got).to_pylist()] == [0, 1] * vectorised.SLICE + [0]


def test_rows_meet_their_own_results(spark):
    n = 3 * vectorised.SLICE + 1
    df = spark.range(0, n, 1, 1)
    got = df.select("id", text.normalise(F.when(F.col("id") % 3 != 0, F.concat(F.lit("<p>"), "id", F.lit("</p>")))).alias("t")).collect()
    assert {(r["id"], r["t"]) for r in got} == {(i, str(i) if i % 3 else None) for i in range(n)}
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("## RISK\nclaim: "), "id").alias("text"), F.lit(None).cast("array<struct<type:string,document_index:int,start_char_index:int,end_char_index:int,cited_text:string>>").alias("citations")))
    got = df.select("id", F.inline(text.claims(F.when(F.col("id") % 3 != 0, blocks)))).collect()
    assert {(r["id"], r["claim"], r["ordinal"], len(r["citations"])) for r in got} == {(i, str(i), 1, 0) for i in range(n) if i % 3}
