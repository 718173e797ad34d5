"""Sections of reports whose parts are known."""

import pytest

from grainledger.operators import sections

WORD = "Narrative text about the company. "


def body(n):
    return (WORD * (n // len(WORD) + 1))[:n] + "\n"


def report(*parts):
    return "".join(body(p) if isinstance(p, int) else p for p in parts)


FULL = ("PART I\nITEM 1. BUSINESS\n", 20_000, "ITEM 1A. RISK FACTORS\n", 25_000, "ITEM 1B. UNRESOLVED\n", 7_000, "ITEM 7. MANAGEMENT\n", 20_000, "ITEM 8. FINANCIAL\n", 9_000)
CASES = {
    "plain": (report(*FULL), ["high", "high", "high"], "sections"),
    "null": (None, ["failed"] * 3, "full_fallback"),
    "empty": ("", ["failed"] * 3, "full_fallback"),
    "inline": (report("ITEM 1. BUSINESS ", 20_000, "* ITEM 1A. RISK FACTORS ", 25_000, "* ITEM 2. PROPERTIES ", 7_000, "* ITEM 7. MANAGEMENT ", 20_000, "* ITEM 7A. QUANTITATIVE ", 9_000), ["high", "low", "high"], "full_fallback"),
    "by reference": (report(*FULL[:6], "ITEM 7. MANAGEMENT'S DISCUSSION is Incorporated by Reference to the annual report.\nITEM 7A. QUANTITATIVE\n", 9_000), ["high", "high", "incorporated_by_reference"], "sections_partial"),
    "late list": (report(*FULL[:8], "ITEM 7A. Q\nITEM 8. F\nITEM 9. C\nITEM 9B. O\n", 9_000), ["high", "high", "high"], "sections"),
    "mentions": (report("As described in Item 1A, Item 7 and Item 8 below, ", *FULL[:3], "see \"Item 7. Management\" hereof, and under Item 2 ", *FULL[3:]), ["high", "high", "high"], "sections"),
    "two starts": (report("ITEM 1. BUSINESS\n", 9_000, *FULL), None, "full_fallback"),
    "too long": (report("ITEM 1. BUSINESS\n", 120_000, *FULL[2:]), ["failed", "high", "high"], "full_fallback"),
    "digits": (report(*FULL[:7], "1234 5678 " * 2_000, *FULL[8:]), ["high", "high", "failed"], "full_fallback"),
    "no seven": (report(*FULL[:6]), ["failed"] * 3, "full_fallback"),
    "other items": (report("ITEM 10. X\n", "ITEM 1D. X\n", "ITEM 7B. X\n", 9_000), ["failed"] * 3, "full_fallback"),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, *_) in CASES.items()], "id string, t string").repartition(3).cache()
    spans = sections.extracted_sections(docs, "id", "t")
    got = {}
    for r in spans.collect():
        got.setdefault(r["id"], {})[r["item"]] = r
    return got, {r["id"]: (r["method"], r["usable"]) for r in sections.extraction_method(spans, docs, "id", "t").collect()}


@pytest.mark.parametrize("case", CASES)
def test_grades(found, case):
    text, want, method = CASES[case]
    rows, methods = found
    if want:
        assert [rows[case][i]["confidence"] for i in ("1", "1A", "7")] == want
    assert methods[case] == (method, method != "full_fallback" or len(text or "") >= 20_000)


def test_spans_and_reasons(found):
    text, rows = CASES["plain"][0], found[0]
    for item, lead, end in (("1", "ITEM 1. BUSINESS", "ITEM 1A."), ("1A", "ITEM 1A. RISK", "ITEM 1B."), ("7", "ITEM 7. MANAGEMENT", "ITEM 8.")):
        r = rows["plain"][item]
        assert (r["start"], r["end"], r["length"]) == (text.index(lead) + len(lead), text.index(end), r["end"] - r["start"])
    assert [rows["null"][i]["reason"] for i in ("1", "1A", "7")] == ["no_candidate"] * 3
    assert [rows["no seven"][i]["reason"] for i in ("1", "1A", "7")] == ["no_consistent_assignment"] * 2 + ["no_candidate"]
    assert rows["too long"]["1"]["reason"] == "above_max_ratio" and rows["digits"]["7"]["reason"] == "below_alpha_ratio"
    assert rows["inline"]["1A"]["low_reasons"] == "heading_boundaries" and rows["inline"]["1A"]["end_item"] == "2"
    assert rows["two starts"]["1"]["tie"] and rows["two starts"]["7"]["low_reasons"] == "single_or_no_tiebreak"


def test_empty(spark):
    none = spark.createDataFrame([], "id string, t string")
    assert sections.extraction_method(sections.extracted_sections(none, "id", "t"), none, "id", "t").count() == 0
