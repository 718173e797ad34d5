"""Scores that lie on a bar."""

from pyspark.sql import functions as F

from grainledger.operators import evaluation

NAMES = ("business", "moat", "strength", "management", "valuation", "risk")


def test_left_out_score_on_the_bar(spark):
    """0.15 * 28 + 0.25 * 62 + 0.05 * 56 over 0.45 is 50; each weight divided by 0.45 first gives 49.99999999999999."""
    df = spark.createDataFrame([(1, 10.0, 10.0, 28.0, 10.0, 62.0, 44.0, "low")], "k int, " + ", ".join(f"{n} double" for n in NAMES) + ", severity string")
    got = {r["scenario"]: (r["score"], r["status"]) for r in evaluation.counterfactuals(df, "k").collect()}
    assert got["quality_left_out"] == (50.0, "watch")


def test_recorded_score_on_the_bar(spark):
    """These whole numbers weigh exactly 70, which doubles miss."""
    kind = "ticker int, " + ", ".join(f"{n} long" for n in NAMES) + ", severity string, status string, valuation_run_id string, quality_run_id string"
    df = spark.createDataFrame([(1, 100, 44, 56, 65, 71, 29, "low", "Watch", "v", "q"), (2, 100, 44, 56, 65, 71, 29, "low", "Investigate", "v", "q")], kind)
    df = df.withColumn("overall_score", evaluation.overall_score({n: F.col(n) for n in NAMES}))
    assert [tuple(r) for r in evaluation.record_issues(df, "v", "q").collect()] == [(1, "committee_status_formula_mismatch")]
    assert df.first()["overall_score"] == 70.0


def test_edges_of_parts_are_fixed_before_they_are_used(spark):
    """Approximate quantiles come out otherwise in another run, and rows and their sums are parted by the same ones."""
    from grainledger.operators import series

    df = spark.range(50).selectExpr("id % 2 AS g", "CAST(id AS double) AS v")
    got = series.value_counts(df, ["g"], "v", 4)
    assert "percentile_approx" not in got._jdf.queryExecution().toString()
    assert sorted((r["g"], r["v"], r["upto"]) for r in got.collect()) == sorted((i % 2, float(i), i // 2 + 1) for i in range(50))
