"""Exports of a benchmark: strict records, grades, stars, headings; texts; stale analyses and caps."""

import json

import pytest
from pyspark.sql import functions as F

from grainledger.operators import benchmarking, committee, evidence, facts


def test_strict_benchmark(spark, tmp_path):
    good = {"ticker": " brk.b ", "economic_moat": None, "snapshot_date": "2024-02-29", "uncertainty": "High", "star_rating": "★★★☆☆", "fair_value": 10.5}
    lines = {
        "good": good, "unset": {**good, "ticker": "AAA", "uncertainty": None, "star_rating": None, "fair_value": None}, "shape": {**good, "ticker": "?x"}, "no ticker": {**good, "ticker": None}, "moat": {**good, "ticker": "B", "economic_moat": "Vast"},
        "set": {**good, "ticker": "C", "uncertainty": "high"}, "day": {**good, "ticker": "D", "snapshot_date": "2023-02-29"}, "time": {**good, "ticker": "E", "snapshot_date": "2024-2-9"}, "stars": {**good, "ticker": "F", "star_rating": "six"},
        "more": {**good, "ticker": "G", "odd": 1}, "less": {k: v for k, v in good.items() if k != "economic_moat"} | {"ticker": "H"}, "twice": {**good, "ticker": "I"}, "again": {**good, "ticker": "i "},
    }
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in lines.values()) + "\nnot json\n\n")
    records, issues = benchmarking.benchmark_records(spark, str(tmp_path / "b.jsonl"), ["ticker", "economic_moat", "snapshot_date"], ["uncertainty", "star_rating", "fair_value"], ["fair_value"], economic_moat=("Wide", "Narrow", "None"))
    assert sorted((r["ticker"], r["fair_value"]) for r in records.collect()) == [("AAA", None), ("BRK-B", 10.5)]
    assert sorted((r["ticker"], r["code"]) for r in issues.collect()) == sorted([
        ("?x", "unmapped_ticker"), ("", "unmapped_ticker"), ("B", "unknown_value"), ("C", "unknown_value"), ("D", "invalid_date"), ("E", "invalid_date"), ("F", "invalid_value"), ("G", "unknown_key"), ("H", "missing_key"), ("I", "duplicate"), ("I", "duplicate"), ("", "unparsable"),
    ])


@pytest.mark.parametrize(("raw", "grade", "stars"), [("A", 4.0, None), (" b+ ", 3.33, None), ("F-", -0.33, None), ("E", None, None), ("A++", None, None), ("", None, None), (None, None, None), ("3", None, 3), ("4 stars", None, 4), ("5.0", None, 5), ("6", None, None), ("0", None, None), ("★★★☆☆", None, 3), ("☆☆", None, None), ("★★★★★★", None, None), ("★ x", None, None)])
def test_grades_and_stars(spark, raw, grade, stars):
    row = spark.createDataFrame([(raw,)], "x string").select(benchmarking.grade_ordinal(F.col("x")), benchmarking.star_rating(F.col("x"))).first()
    assert (row[0] is None) == (grade is None) and (grade is None or abs(row[0] - grade) < 1e-12) and row[1] == stars


def test_headings():
    field = benchmarking.field_of
    assert [field(h) for h in ("EBITDA (Mil)", "EBIT", "Return on Equity\n(Forward) %", "Return on Equity %", "Industry Group", "Industry", "Other", "", None)] == ["ebitda", "ebit", "roe_forward", "roe", "ms_industry_group", "ms_industry", None, None, None]


def test_formats(spark):
    df = spark.createDataFrame([(0.125,), (-1234.565,), (None,), (0.0005,)], "v double")
    got = df.select(benchmarking.percent(F.col("v"), 1, True), benchmarking.money(F.col("v")), benchmarking.times(F.col("v"))).collect()
    want = [None if v is None else (f"{v:+.1%}", f"${v:,.2f}", f"{v:.1f}x") for v in (0.125, -1234.565, None, 0.0005)]
    assert [tuple(r) if r[0] is not None else None for r in got] == want


def test_caps(spark):
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model string, input_price double, output_price double")
    requests = spark.createDataFrame([("m", 1_000_000, False), ("m", 1_000_000, True)], "model string, input_tokens long, batch boolean")
    rows = committee.projected_cost(requests, prices)
    assert sorted(r["projected"] for r in rows.collect()) == [pytest.approx(1.56), pytest.approx(3.12)]
    assert not committee.within_cap(rows, 4.0).first()["may_send"] and committee.within_cap(rows.limit(0), 0.0).first()["may_send"]


def test_stale_analyses(spark):
    analyses = spark.createDataFrame([("r2", "A", "moat", True, "r1"), ("r2", "A", "risk", True, None)], "run_id string, ticker string, analysis_type string, is_current boolean, reused_from_run_id string")
    claims = spark.createDataFrame([(1, "r1", "A", "moat", 1), (2, "r2", "A", "risk", 1)], "claim_id int, run_id string, ticker string, analysis_type string, claim_order int")
    events = spark.createDataFrame([(1, 10, 1, "exact"), (1, 10, 2, "fuzzy"), (1, 11, 1, "exact"), (2, 20, 1, "unresolved"), (2, 20, 3, "moved")], "claim_id int, citation_id int, checked_at int, result string")
    got = {r["analysis_type"]: (r["run_id"], r["degraded"], r["checked"], r["stale"]) for r in evidence.stale_analyses(analyses, claims, events).collect()}
    assert got == {"moat": ("r2", 1, 2, True), "risk": ("r2", 0, 1, False)}


def test_registry(spark):
    rows = facts.tag_registry(spark).collect()
    assert len({r["metric"] for r in rows}) == 12 and len({r["tag"] for r in rows}) == len(rows)
    assert [r["tag"] for r in sorted(rows, key=lambda r: r["priority"]) if r["metric"] == "net_income"] == ["NetIncomeLoss", "ProfitLoss"]
