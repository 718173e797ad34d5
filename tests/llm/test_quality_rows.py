"""op8 learns from every labelled document."""

from pyspark.sql import functions as F

from grainledger.llm import quality


def test_threshold_counts_all_labelled_rows(spark):
    """As many labelled texts lie under the threshold as have a bad label, among more of them than a sample would hold."""
    df = spark.range(0, 20_000, 1, 4).selectExpr("id AS doc_id", "concat(repeat('ab ', CAST(id % 150 AS int) + 1), repeat('Z9! ', CAST(id div 150 AS int) + 1)) AS text", "CAST(pmod(xxhash64(id), 200) < id % 150 AS int) AS quality")
    model = quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = quality.quality_scores(df.select("doc_id", "text"), model)
    bad = df.where("quality = 0").count()
    assert bad > 8_000 and abs(got.where(F.col("predicted") == 0).count() - bad) <= 1
    assert quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality")).threshold == model.threshold
