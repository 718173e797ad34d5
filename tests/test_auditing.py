"""Chains, repeats, replays and comparisons with known answers."""

import pytest

from grainledger.operators import auditing, comparing, evaluation


def test_reuse_faults(spark):
    rows = [(1, "a", None, "k"), (2, "a", 1, "k"), (3, "a", 2, "k"), (4, "a", 99, "k"), (5, "a", 4, "k"), (6, "a", 1, "x"), (7, "a", 6, "x"), (8, "a", 9, "k"), (9, "a", 8, "k"), (10, "a", 9, "k"), (11, "a", 11, "k"), (12, "b", 1, "k"), (13, "a", 14, None), (14, "a", None, None), (15, "a", 16, "k"), (16, "a", 15, "y"), (14, "a", None, None)]
    rows += [(100 + i, "c", 100 + i - 1 if i else None, "k" if i != 40 else "z") for i in range(90)]
    got = {r["run_id"]: r["code"] for r in auditing.reuse_faults(spark.createDataFrame(rows, "run_id long, ticker string, reused_from_run_id long, cache_key string")).collect()}
    want = dict.fromkeys((4, 5, 12), auditing.SOURCE_MISSING) | dict.fromkeys((6, 7, 15, 16), auditing.KEY_DIFFERS) | dict.fromkeys((8, 9, 10, 11), auditing.CYCLE) | dict.fromkeys(range(140, 190), auditing.KEY_DIFFERS)
    assert got == want
    assert auditing.reuse_faults(spark.createDataFrame([], "run_id long, ticker string, reused_from_run_id long, cache_key string")).count() == 0


SCORES = {"business": 80.0, "moat": 80.0, "strength": 80.0, "management": 80.0, "valuation": 80.0, "risk": 20.0}
KIND = "ticker string, reused_from_run_id string, quality_run_id string, valuation_run_id string, cache_key string, status string, severity string, overall_score double, " + ", ".join(f"{c} double" for c in SCORES)


def verdict(ticker="A", reused=None, quality="q", valuation="v", key="k", status="Investigate", severity="low", score=80.0, **scores):
    return (ticker, reused, quality, valuation, key, status, severity, score, *(SCORES | scores).values())


def refusal(spark, stored=None, replicate=None, bundles=(("A", "k"), ("B", "k")), others=None, runs=(("r", "committee", "complete"),), no_replicate=False, **more):
    frame = lambda rows: spark.createDataFrame(rows or [verdict(), verdict("B")], KIND)
    known = dict(replicate_run="r", frozen_runs=["f"], quality_run="q", valuation_run="v", digests=("d", "d", "d"), aliased=False, provenance="same") | more
    bundle = lambda b: spark.createDataFrame(list(b), "ticker string, bundle string")
    row = auditing.admissibility(frame(stored), None if no_replicate else frame(replicate), spark.createDataFrame(list(runs), "run_id string, stage_reached string, status string"), bundle(bundles), bundle(others or bundles), **known).first()
    return row["reason"], row["detail"]


@pytest.mark.parametrize(("case", "reason", "detail"), [
    ({}, None, None),
    ({"replicate_run": None}, 0, None), ({"replicate_run": "f"}, 1, None), ({"no_replicate": True}, 2, None), ({"digests": ("d", "d", "e")}, 3, None), ({"digests": (None, None, None)}, 3, None), ({"aliased": True}, 4, None),
    ({"runs": [("x", "committee", "complete")]}, 5, None), ({"provenance": None}, 6, None), ({"runs": [("r", "valuation", "complete")]}, 7, None), ({"runs": [("r", "committee", "failed")]}, 7, None),
    ({"replicate": [verdict(), verdict(), verdict("B")]}, 8, None), ({"replicate": [verdict(), verdict("C")]}, 9, None), ({"replicate": [verdict(reused="x"), verdict("B")]}, 10, None), ({"stored": [verdict(quality="old"), verdict("B")]}, 11, None), ({"replicate": [verdict(valuation=None), verdict("B")]}, 11, None),
    ({"bundles": [("A", "k")]}, 12, '{"candidate_bundle_unavailable":1,"replicate_bundle_unavailable":1}'),
    ({"others": [("A", "k"), ("B", "z")]}, 12, '{"cross_snapshot_bundle_mismatch":1,"replicate_cache_key_mismatch":1}'),
    ({"stored": [verdict(score=70.0), verdict("B", status="Watch")]}, 13, None), ({"stored": [verdict(moat=float("nan")), verdict("B", risk=None)]}, 13, None),
    ({"stored": [verdict(severity="high", status="Watch"), verdict("B", status="Watch")]}, None, None),
])
def test_admissibility(spark, case, reason, detail):
    assert refusal(spark, **case) == (None if reason is None else auditing.REFUSALS[reason], detail)


def test_invalid_companies_abstain(spark):
    invalid = spark.createDataFrame([("A",), ("B",), ("B",)], "ticker string")
    assert refusal(spark, invalid=invalid) == (auditing.REFUSALS[13], None)


def test_replays(spark):
    metrics = dict.fromkeys(auditing.METRICS, "fail") | dict.fromkeys(auditing.METRICS[:3], "pass")
    better = metrics | {auditing.METRICS[3]: "pass"}
    value, cheap = (10.0, 20.0, 30.0, 15.0), (10.0, 20.0, 30.0, 5.0)
    struct = "struct<bear:double,base:double,bull:double,price:double>"
    rows = [
        ("f", "A", "screen", "e", True, metrics, better, None, None), ("g", "A", "screen", "e", True, better, metrics, None, None), ("h", "A", "screen", "", True, metrics, better, None, None), ("i", "A", "screen", "e", False, metrics, better, None, None),
        ("j", "A", "screen", "e", True, metrics, {**better, "other": "pass"}, None, None), ("k", "A", "screen", "e", True, metrics, better | {"roe": "maybe"}, None, None), ("l", "A", "monitor", "e", True, metrics, better, None, None), ("m", "Z", "screen", "e", True, metrics, better, None, None),
        ("n", "A", "valuation", "e", True, None, None, value, cheap), ("o", "A", "valuation", "e", True, None, None, cheap, value), ("p", "A", "valuation", "e", True, None, None, value, None), ("q", "A", "valuation", "e", True, None, None, value, (10.0, 20.0, 15.0, 5.0)),
    ]
    records = spark.createDataFrame(rows, f"fix_id string, ticker string, stage string, evidence string, held_constant boolean, before_metrics map<string,string>, after_metrics map<string,string>, before_values {struct}, after_values {struct}")
    got = {r["fix_id"]: (r["transition"], r["fault"]) for r in auditing.replays(records, spark.createDataFrame([("A", metrics)], "ticker string, metrics map<string,string>"), spark.createDataFrame([("A", value)], f"ticker string, values {struct}")).collect()}
    assert got == {
        "f": ("fail_to_pass", None), "g": (None, "before_is_not_frozen"), "h": (None, "evidence_missing"), "i": (None, "not_held_constant"), "j": (None, "unknown_metrics"), "k": (None, "unknown_status"), "l": (None, "unknown_stage"), "m": (None, "before_is_not_frozen"),
        "n": ("fair_to_cheap", None), "o": (None, "before_is_not_frozen"), "p": (None, "unknown_values"), "q": ("fair_to_abstain", None),
    }


def test_comparison_rules(spark):
    figures = {c: 1e6 for c in {**comparing.MONETARY, **comparing.RATIOS, **comparing.OTHERS}.values()} | {"roe": 0.1, "operating_margin": 0.2, "gross_margin": 0.30, "roic": 0.15}
    names = sorted(figures)
    own = spark.createDataFrame([(t, y, "2024-12-31", flags, *[figures[n] for n in names]) for t, flags in (("A", None), ("B", comparing.LEASES), ("C", None)) for y in (2023, 2024)], "ticker string, fiscal_year int, p string, quality_flags string, " + ", ".join(f"{n} double" for n in names)).selectExpr("*", "date(p) AS period_end_date")
    stated = ("revenue", "net_income", "ebit", "operating_cash_flow", "capex", "free_cash_flow", "total_debt", "cash_and_equiv", "total_equity", "gross_margin", "operating_margin", "roic", "roe", "shares_outstanding")
    row = (1.0, float("nan"), 1.0, 1.0, -1.0, 1.0, 1.0, None, 1.0, 30.9, 20.0, 17.0, 10.0, 1.0)
    bench = spark.createDataFrame([("A", "2025-04-30", *row), ("B", "2025-05-01", *row), ("C", "2024-12-30", *row), ("D", "2025-01-01", *row)], "ticker string, s string, " + ", ".join(f"{n} double" for n in stated)).selectExpr("*", "date(s) AS snapshot_date")
    who = spark.createDataFrame([("A", "USD"), ("B", None), ("C", "EUR")], "ticker string, currency string")
    got = {(r["ticker"], r["field"]): r for r in comparing.field_comparisons(bench, own, who, ending_equity=True).collect()}
    outcome = lambda t, f: (got[t, f]["outcome"], got[t, f]["rule"].split("_")[0])
    assert len(got) == 4 * 16
    assert outcome("A", "revenue") == ("Inconclusive", "ttm") and outcome("C", "revenue") == ("Inconclusive", "currency") and outcome("A", "shares_outstanding") == ("Inconclusive", "ttm")
    assert outcome("A", "net_income") == outcome("A", "cash_and_equiv") == outcome("D", "revenue") == outcome("A", "depreciation_amortization") == ("Unavailable", "one")
    assert outcome("A", "total_debt") == ("Definitional difference", "lease") and outcome("B", "total_debt") == ("Inconclusive", "ttm") and outcome("A", "free_cash_flow") == ("Definitional difference", "own")
    assert outcome("A", "gross_margin") == ("Match", "absolute") and outcome("A", "roic") == ("Probable defect", "absolute") and outcome("C", "gross_margin") == ("Match", "absolute") and outcome("A", "roe") == ("Definitional difference", "baseline")
    assert outcome("A", comparing.HYPOTHESIS)[0] == "Probable defect" and got["A", "capex"]["benchmark_value"] == 1e6
    assert got["A", "revenue"]["near_period"] and not got["B", "revenue"]["near_period"] and not got["C", "revenue"]["near_period"]
    again = {(r["ticker"], r["field"]): r["outcome"] for r in comparing.field_comparisons(bench, own, who, ending_equity=False).collect()}
    assert again["A", "roe"] == "Match" and again["C", "roe"] == "Match"
