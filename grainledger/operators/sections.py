"""Items 1, 1A and 7 of annual reports: candidates, consistent triples, boundaries, grades and the document's method.

A helper reads each text once and says what stands where: headings of items, and why one isn't a section's start. The choice
among them, the ends of the sections and their grades are columns over these arrays, a row a document and then a row a section.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.functions.vectorised import vectorised

# Titles that a heading may carry, ends of each section in order with how many of them are its proper end, floors
# and shares of a section, windows of the tests, and the words that make a mention of an item a reference.
TITLES = {"1": "BUSINESS", "1A": "RISK", "1B": "UNRESOLVED", "1C": "CYBERSECURITY", "2": "PROPERTIES", "7": "MANAGEMENT", "7A": "QUANTITATIVE", "8": "FINANCIAL"}
ENDS = {"1": (("1A",), 1), "1A": (("1B", "1C", "2"), 1), "7": (("7A", "8"), 2)}
FLOOR, GOOD = 5_000, {"1": 15_000, "1A": 20_000, "7": 15_000}
MOST_OF_DOCUMENT, LEAST_ALPHA, FRONT = 0.60, 0.55, 0.20
CONTENTS_SPAN, CONTENTS_ITEMS, LEADER_SPAN, PART_BEFORE, PART_AFTER, REFERENCE_SPAN = 6_000, 4, 120, 80, 200, 500
BY_REFERENCE = "incorporated by reference"
LEAST_DOCUMENT = 20_000
REFERS = r"\b(?:described\s+in|included\s+in|pursuant\s+to|referred?\s+to|see|in|under)\s*$"

_ITEM = re.compile(r"item\s+(\d+[a-c]?)", re.I)
_TAIL = {k: re.compile(rf"\.?\s*[-–—]?\s*(?:{t}\b)?", re.I) for k, t in TITLES.items()}
_REFERS = re.compile(REFERS, re.I)
_LEADER = re.compile(r"\.{4,}|\s{2,}\d{1,3}\s*\n")
_PART = re.compile(r"part\s+i{1,2}(?!i)(?!\w)", re.I)


def _refers(text: str, at: int) -> bool:
    """Whether what stands before it on its line makes an item's mention a part of a sentence."""
    before = text[text.rfind("\n", 0, at) + 1 : at].rstrip().rstrip("\"'“”‘’").rstrip()
    return bool(before) and (before[-1] == "," or before[-1].isalpha() and before[-1].islower() or bool(_REFERS.search(before)))


def _headings(text: str | None) -> list[tuple]:
    """(item, at, end, why not a start, end of a phrase of reference after it) of each heading of an item in TITLES."""
    found = [(m[1].upper(), m.start(), m.end(), _refers(text, m.start())) for m in _ITEM.finditer(text or "")]
    out, high = [], len(found)
    ahead: dict[str, int] = {}  # items named within the window ahead
    for k in range(len(found) - 1, -1, -1):
        item, at, stop, refers = found[k]
        if not refers:
            ahead[item] = ahead.get(item, 0) + 1
        while found[high - 1][2] > at + CONTENTS_SPAN:
            high -= 1
            if not found[high][3] and high >= k:
                ahead[found[high][0]] -= 1
        if item not in TITLES or (text[stop : stop + 1].isalnum() or text[stop : stop + 1] == "_"):
            continue
        end = _TAIL[item].match(text, stop).end()
        why = None
        if sum(n > 0 for n in ahead.values()) >= CONTENTS_ITEMS:
            why = "toc_cluster"
        elif _LEADER.search(text, end, end + LEADER_SPAN):
            why = "dot_leader"
        elif refers:
            why = "cross_reference"
        elif _PART.search(text, max(0, at - PART_BEFORE), at) and _ITEM.search(text, end, end + PART_AFTER):
            why = "part_header_only"
        phrase = text[end : end + REFERENCE_SPAN].lower().find(BY_REFERENCE)
        out.append((item, at, end, why, refers, phrase + len(BY_REFERENCE) if phrase >= 0 else None))
    return out[::-1]


@vectorised("array<struct<item:string,at:int,end:int,rejection:string,refers:boolean,reference_end:int>>")
def headings(text: pd.Series) -> pd.Series:
    """Headings of items in a text, in order; none for a null or empty text."""
    return text.map(_headings)


def _end(bounds: Column, item: str, after: Column, length: Column) -> Column:
    """struct<at, item, rung> of the first end of a section behind ``after``; the document's end, with nulls, where there is none."""
    behind = F.filter(bounds, lambda b: (b["at"] > after) & b["item"].isin(*ENDS[item][0]))
    best = F.array_min(F.transform(behind, lambda b: F.struct(b["at"].alias("at"), b["item"].alias("item"), (F.array_position(F.array(*map(F.lit, ENDS[item][0])), b["item"]) - 1).cast("int").alias("rung"))))
    return F.coalesce(best, F.struct(length.cast("int").alias("at"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("int").alias("rung")))


def extracted_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each document and item of 1, 1A and 7.

    Columns: key, item, confidence (high, low, failed, incorporated_by_reference), start, end, length, end_item, end_rung, reason
    (of a failure), low_reasons (joined by commas), tie (more than one consistent triple).

    A triple is consistent if the headings follow each other and each section has FLOOR characters or is incorporated by
    reference; of several the earliest is taken, by the first heading, then the second, then the third. A null or empty
    text has no candidate.
    """
    d = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_n", F.length("_t")).withColumn("_h", headings("_t"))
    own = lambda item: F.filter("_h", lambda h: (h["item"] == item) & h["rejection"].isNull())
    # ends of sections: headings of other items that aren't mentioned in a sentence
    bounds = F.filter("_h", lambda h: ~h["item"].isin("1", "1A", "7") & ~h["refers"])
    d = d.withColumn("_b", bounds).withColumn("_toc", F.coalesce(F.array_max(F.transform(F.filter("_h", lambda h: h["item"].isin("1", "1A", "7") & (h["rejection"] == "toc_cluster") & (h["at"] <= FRONT * F.col("_n"))), lambda h: h["at"])), F.lit(-1)))

    def enough(item: str):
        def test(h: Column) -> Column:
            length = _end(F.col("_b"), item, h["end"], F.col("_n"))["at"] - h["end"]
            return (length >= FLOOR) | F.coalesce(h["reference_end"] <= length, F.lit(False))

        return test

    for name, item in (("_one", "1"), ("_a", "1A"), ("_seven", "7")):
        d = d.withColumn(name, own(item))
    d = d.withColumn("_v7", F.filter("_seven", enough("7"))).withColumn("_va", F.filter("_a", enough("1A")))
    later = F.transform("_va", lambda a: F.struct(a["at"].alias("at"), a["end"].alias("end"), a["reference_end"].alias("reference_end"), F.size(F.filter("_v7", lambda s: s["at"] > a["at"])).alias("ways")))
    d = d.withColumn("_va", F.filter(later, lambda a: a["ways"] > 0))
    need = lambda c: c["end"] + F.least(F.lit(FLOOR), F.coalesce(c["reference_end"], F.lit(FLOOR)))
    pairs = F.transform("_one", lambda c: F.struct(c.alias("c"), F.filter("_va", lambda a: a["at"] >= need(c)).alias("a")))
    d = d.withColumn("_p", F.filter(pairs, lambda p: F.size(p["a"]) > 0))
    ways = F.aggregate(F.transform("_p", lambda p: F.aggregate(p["a"], F.lit(0).cast("long"), lambda n, a: n + a["ways"])), F.lit(0).cast("long"), lambda n, x: n + x)
    d = d.withColumn("_ways", ways).withColumn("_c1", F.get("_p", F.lit(0))["c"]).withColumn("_ca", F.get(F.get("_p", F.lit(0))["a"], F.lit(0)))
    d = d.withColumn("_c7", F.get(F.filter("_v7", lambda s: s["at"] > F.col("_ca.at")), F.lit(0)))

    def row(item: str, c: str, survivors: str, end: Column) -> Column:
        return F.struct(F.lit(item).alias("item"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.end").alias("start"), F.col(f"{c}.reference_end").alias("reference_end"), end.alias("e"), (F.size(survivors) > 0).alias("some"))

    first = F.struct(F.col("_ca.at").alias("at"), F.lit("1A").alias("item"), F.lit(0).alias("rung"))
    rows = F.array(row("1", "_c1", "_one", first), row("1A", "_ca", "_a", _end(F.col("_b"), "1A", F.col("_ca.end"), F.col("_n"))), row("7", "_c7", "_seven", _end(F.col("_b"), "7", F.col("_c7.end"), F.col("_n"))))
    s = d.select("_key", "_t", "_n", "_toc", "_ways", F.inline(rows)).withColumn("end", F.col("e.at")).withColumn("length", F.col("end") - F.col("start"))
    span = F.substring(F.col("_t"), F.col("start") + 1, F.col("length"))
    solid = F.length(F.regexp_replace(span, r"[\s\x1c-\x1f\x85\p{Z}]", ""))
    alpha = F.length(F.regexp_replace(span, r"[^\p{L}]", "")) / F.greatest(solid, F.lit(1))
    s = s.withColumn("alpha", alpha).withColumn("share", F.col("length") / F.col("_n")).drop("_t")
    by = {i: F.col("item") == i for i in GOOD}
    pick = lambda values: F.coalesce(*[F.when(by[i], F.lit(v)) for i, v in values.items()])
    reason = (
        F.when(F.col("_ways") == 0, F.when(F.col("some"), "no_consistent_assignment").otherwise("no_candidate"))
        .when(F.col("length") < FLOOR, F.when(F.col("reference_end") <= F.col("length"), F.lit(None)).otherwise("below_hard_floor"))
        .when(F.col("share") > MOST_OF_DOCUMENT, "above_max_ratio").when(F.col("alpha") < LEAST_ALPHA, "below_alpha_ratio")
    )
    low = F.array_compact(F.array(
        F.when(F.col("_ways") > 1, "single_or_no_tiebreak"),
        F.when(F.col("e.rung").isNull() | (F.col("e.rung") >= pick({i: n for i, (_, n) in ENDS.items()})), "heading_boundaries"),
        F.when(F.col("length") < pick(GOOD), "length_gte_high_floor"),
        F.when(F.col("at") <= F.col("_toc"), "after_last_toc_cluster"),
    ))
    referred = (F.col("_ways") > 0) & (F.col("length") < FLOOR) & (F.col("reference_end") <= F.col("length"))
    s = s.withColumn("reason", reason).withColumn("low", low)
    confidence = F.when(F.coalesce(referred, F.lit(False)), "incorporated_by_reference").when(F.col("reason").isNotNull(), "failed").when(F.size("low") == 0, "high").otherwise("low")
    found = F.col("_ways") > 0
    s = s.withColumn("confidence", confidence)
    return s.select(
        F.col("_key").alias(key), "item", "confidence", *[F.when(found, F.col(c)).alias(c) for c in ("start", "end", "length")],
        F.when(found, F.col("e.item")).alias("end_item"), F.when(found, F.col("e.rung")).alias("end_rung"), "reason",
        F.when(F.col("confidence") == "low", F.array_join("low", ",")).otherwise("").alias("low_reasons"), (F.col("_ways") > 1).alias("tie"),
    )


def extraction_method(sections: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, method, usable: of each document with rows in ``sections``.

    Method: sections where all are high, sections_partial where the others are incorporated by reference, else full_fallback,
    for which a document must have LEAST_DOCUMENT characters to be usable.
    """
    n = sections.groupBy(key).agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "incorporated_by_reference")], F.count("*").alias("n"))
    method = F.when(F.col("high") == F.col("n"), "sections").when((F.col("incorporated_by_reference") > 0) & (F.col("high") + F.col("incorporated_by_reference") == F.col("n")), "sections_partial").otherwise("full_fallback")
    sizes = docs.select(key, F.coalesce(F.length(text), F.lit(0)).alias("_n"))
    return n.select(key, method.alias("method")).join(sizes, key).select(key, "method", ((F.col("method") != "full_fallback") | (F.col("_n") >= LEAST_DOCUMENT)).alias("usable"))
