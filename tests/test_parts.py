"""Where large tables meet, parts hold a bounded number of rows whatever the tables' size."""

import pytest

from grainledger import session
from grainledger.plans import benchmarks, evidencing, valuing

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [valuing.six_valuations, benchmarks.stale_analyses, evidencing.filing_evidence], ids=lambda q: q.__name__)
def test_parts_follow_the_rows(spark, monkeypatch, query):
    """With parts of 500 rows the 6,000 lines are dealt into 12 or 13, and the rows are the same."""
    rows = lambda: sorted(map(str, query(spark, DIR).collect()))
    want = rows()
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    monkeypatch.setattr(session, "PART_ROWS", 500)
    assert f", {-(-lines // 500)}), REPARTITION_BY_NUM" in query(spark, DIR)._jdf.queryExecution().toString()
    assert rows() == want


def test_several_batches_are_retrieved_at_once(spark):
    """As one after the other, and the rows meet their results once."""
    from grainledger.operators import lifecycle

    attempts = lifecycle.submitted(spark.createDataFrame([("r", t, b, "m", t * 8) for t, b in (("x", "1"), ("y", "2"), ("z", "3"))], "run_id string, ticker string, batch_id string, model_id string, prompt_sha256 string"), spark.createDataFrame([], lifecycle.ATTEMPT))
    results, issues = attempts.selectExpr("custom_id", "'end_turn' AS stop_reason", "2.0D AS cost"), attempts.where("ticker = 'y'").selectExpr("custom_id", "'uncited' AS code")
    once = lifecycle.retrieved(attempts, ("1", "2"), results, issues)
    each = lifecycle.retrieved(lifecycle.retrieved(attempts, "1", results, issues), "2", results, issues)
    assert sorted(once.collect()) == sorted(each.collect())
    assert sorted((r["ticker"], r["outcome"]) for r in once.collect()) == [("x", "persisted"), ("y", "validation_failed"), ("z", "pending")]
