"""Evidence, keys and readers on cases with known answers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from grainledger.functions import keys
from grainledger.operators import evaluation, evidence
from grainledger.sources import readers


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_citation_states(spark):
    documents = spark.createDataFrame([("a", "s", 1, "x", "The quick fox"), ("b", "s", 1, "y", None), (None, "s", 1, "z", "text")], "accession string, section_id string, norm_version int, doc_sha256 string, text string")
    cases = [(1, "a", "x", 4, 9, "quick", True), (2, "a", "old", 4, 9, "quick", True), (3, "a", "x", 4, 9, "quirk", True), (4, "a", "x", 9, 14, " fox", True), (5, "a", "x", -1, 3, "The", True), (6, "a", "x", 4, 4, "", True), (7, "b", "y", 0, 1, "T", True), (8, "c", "x", 0, 1, "T", True), (9, "a", "x", 4, 9, "quick", False), (10, None, "z", 0, 4, "text", True)]
    cited = spark.createDataFrame([(i, a, "s", 1, sha, s, e, q, now) for i, a, sha, s, e, q, now in cases], "citation_id int, accession string, section_id string, norm_version int, doc_sha256 string, start_char int, end_char int, quote string, is_current boolean")
    got = {r["citation_id"]: (r["state"], r["detail"]) for r in evidence.citation_states(cited, documents).collect()}
    open_ = "anchor unresolved"
    assert got == {
        1: ("current", ""), 2: ("stale source", "digest changed"), 3: (open_, "text differs"), 4: (open_, "offsets out of range"), 5: (open_, "offsets out of range"),
        6: (open_, "offsets out of range"), 7: (open_, "text missing"), 8: (open_, "document missing"), 9: ("historical", ""), 10: (open_, "document missing"),
    }


def test_copied_forward_keeps_the_pointer_to_the_source(spark):
    kind = "run_id string, ticker string, analysis_type string, cache_key string, created_at int, reused_from_run_id string, is_current boolean"
    a = spark.createDataFrame([("r1", "T", "moat", "k", 1, None, False), ("r2", "T", "moat", "k", 2, "r1", True), ("r1", "U", "moat", "k", 1, None, True)], kind)
    asked = spark.createDataFrame([("r3", "T", "k", 3), ("r3", "U", "other", 3)], "run_id string, ticker string, cache_key string, created_at int")
    got = values(evidence.copied_forward(a, asked), "run_id", "ticker", "reused_from_run_id", "is_current")
    assert got == sorted([("r1", "T", None, False), ("r2", "T", "r1", False), ("r3", "T", "r1", True), ("r1", "U", None, True)], key=repr)


def test_replicate_refusal(spark):
    kind = "ticker string, reused_from_run_id string, quality_run_id string, valuation_run_id string, cache_key string"
    df = lambda *rows: spark.createDataFrame(list(rows), kind)
    good = ("A", None, "q", "v", "k")
    reason = lambda a, b: evaluation.replicate_refusal(a, b).head()["reason"]
    assert reason(df(good), df(good)) is None
    assert reason(df(good, good), df(good)) == "ambiguous identifiers"
    assert reason(df(good), df(("B", None, "q", "v", "k"))) == "cohorts differ"
    assert reason(df(good), df(("A", "r", "q", "w", "k"))) == "replicate reuses verdicts"
    assert reason(df(good), df(("A", None, "q", "w", "k"))) == "lineage differs"
    assert reason(df(good), df(("A", None, "q", "v", "j"))) == "inputs differ"
    assert reason(df(), df()) is None


def test_linked_suppression_of_zeros_and_nulls(spark):
    df = spark.createDataFrame([("a", "x", 9), ("a", "y", 0), ("b", "x", 5), (None, "x", 7), (None, "y", 2)], "g string, f string, n int")
    got = values(evaluation.linked_suppression(df, ["g"], "n"), "g", "f", "shown", "mark")
    assert got == sorted([("a", "x", None, "linked"), ("a", "y", None, "small"), ("b", "x", 5, None), (None, "x", None, "linked"), (None, "y", None, "small")], key=repr)


def test_stitched_and_monitored(spark):
    row = spark.range(1).select(*[c.alias(k) for k, c in evidence.stitched(F.lit("Q"), F.lit("B"), F.lit("V"), F.lit(71.25), F.lit("Watch")).items()], evidence.to_monitor(F.array(F.lit('a "b"'))).alias("m")).head()
    assert row["investment_thesis"] == "Q\n\nV" and json.loads(row["m"]) == ['a "b"']
    assert row["ai_conclusion"].endswith("/100 — Watch.\n\nQuality Analyst: Q\n\nBear Analyst: B\n\nValuation Analyst: V")


def test_keys_of_odd_values(spark):
    df = spark.createDataFrame([(" brk.b ", "0000066740 |"), ("a b", "none"), (None, None), ("x" * 16, "12345678901")], "t string, c string")
    assert values(df, keys.ticker(F.col("t")), keys.canonical_ticker(F.col("t")), keys.company_key(F.col("c"))) == sorted([("BRK-B", "BRK-B", "0000066740"), ("A B", None, None), (None, None, None), ("X" * 16, None, "12345678901")], key=repr)
    names = spark.createDataFrame([("export_2024-02-30_2024-03-01.csv",), ("export.csv",), ("2024-05-06_b_2024-05-07.csv",)], "n string")
    assert [None if r[0] is None else str(r[0]) for r in names.select(keys.snapshot_date(F.col("n"))).collect()] == ["2024-03-01", None, "2024-05-06"]
    day = spark.range(1).select(keys.months_before(F.lit("2024-03-31").cast("date"), 1).alias("d"), keys.document_url(F.lit("0000000012"), F.lit("1-2-3"), F.lit("d.htm")).alias("u")).head()
    assert str(day["d"]) == "2024-02-29" and day["u"].endswith("/data/12/123/d.htm")


def test_index_readers_and_company_keys(spark, tmp_path):
    page = "<table><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th><th>CIK</th></tr>\n<tr><td><a href='x'>BRK.B</a></td><td>Berk &amp; Co</td><td>Financials</td><td></td><td>0001067983 |</td></tr></table><table><tr><td>no</td></tr></table>"
    (tmp_path / "members.html").write_text(page)
    (tmp_path / "rows.json").write_text(json.dumps({"data": {"data": {"rows": [{"symbol": "aep", "companyName": "American Electric Common Stock, $1", "sector": " "}]}}}))
    (tmp_path / "bulk.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "brk-b", "title": "t"}, "10": {"cik_str": 9, "ticker": "BRK-B", "title": "t"}}))
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "AEP.xml").write_text("<feed><cik>4904</cik></feed>")
    (tmp_path / "feeds" / "NONE.xml").write_text("<feed/>")
    members = readers.index_members(spark, str(tmp_path / "members.html"), "one")
    assert values(members, *members.columns) == [("BRK-B", "Berk & Co", "Financials", None, "one", "0001067983")]
    rows = readers.index_rows(spark, str(tmp_path / "rows.json"), "two")
    assert values(rows, *rows.columns) == [("AEP", "American Electric", None, None, "two", None)]
    both = readers.with_keys(members.unionByName(rows), readers.company_keys(spark, str(tmp_path / "bulk.json")), readers.feed_keys(spark, str(tmp_path / "feeds")))
    assert values(both, "ticker", "cik") == [("AEP", "0000004904"), ("BRK-B", "0000000009")]


def test_frozen_snapshot(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "s"))
    files = [(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in (tmp_path / "s").glob("*.parquet")]
    kind = "name string, content_hash string"
    assert readers.frozen(spark, str(tmp_path / "s"), spark.createDataFrame(files, kind)).count() == 5
    for wrong in ([(files[0][0], "0")], files + [("gone.parquet", "1")], [("other.parquet", files[0][1])]):
        with pytest.raises(ValueError, match="snapshot"):
            readers.frozen(spark, str(tmp_path / "s"), spark.createDataFrame(wrong, kind))
