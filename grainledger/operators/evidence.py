"""What stands behind a figure or a claim: cited texts, runs that were reused, filings and their versions.

Analyses have run_id, ticker, analysis_type, is_current and reused_from_run_id (null unless copied forward); claims have
claim_id, run_id, ticker, analysis_type and claim_order; citations have claim_id and accession.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.operators.series import top_row
from grainledger.session import dealt

#: Sections that a filing should have, in the order in which they are sent, with their titles. Fixed values.
SECTION_TITLES = {"item_1": "Item 1: Business", "item_1a": "Item 1A: Risk Factors", "item_7": "Item 7: MD&A", "full": "Full Filing"}
_RUN = ["run_id", "ticker", "analysis_type"]


def citation_states(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citation_id, state, detail of each citation against the document as it is now.

    Both have accession, section_id, norm_version and doc_sha256; citations start_char, end_char (exclusive, from 0), quote
    and is_current, documents text (null: lost). States: ``historical`` for a claim that is superseded, ``current``,
    ``stale source`` where the document has another digest, ``anchor unresolved`` where the quote isn't at its place.
    Only keys, digests, offsets and quotes of citations are shuffled; a document's text is shuffled once, whatever
    cites it.
    """
    keys = ["accession", "section_id", "norm_version"]
    d = documents.select(*keys, F.col("doc_sha256").alias("_sha"), F.col("text").alias("_text"), F.lit(True).alias("_there"))
    size = F.col("end_char") - F.col("start_char")
    detail = (
        F.when(F.col("_there").isNull(), "document missing").when(~F.col("_sha").eqNullSafe(F.col("doc_sha256")), "digest changed").when(F.col("_text").isNull(), "text missing")
        .when((F.col("start_char") < 0) | (F.col("end_char") > F.length("_text")) | (size <= 0), "offsets out of range")
        .when(~F.substring("_text", F.col("start_char") + 1, size).eqNullSafe(F.col("quote")), "text differs").otherwise("")
    )
    state = F.when(~F.col("is_current"), "historical").when(F.col("detail") == "", "current").when(F.col("detail") == "digest changed", "stale source").otherwise("anchor unresolved")
    return citations.join(d, keys, "left").select("citation_id", "is_current", detail.alias("detail")).select("citation_id", state.alias("state"), "detail")


def shown_claims(analyses: DataFrame, claims: DataFrame, parts: int = 1) -> DataFrame:
    """Claims of each analysis; one that was copied forward shows those of the run that it was copied from."""
    keys = ["claims_run_id", "ticker", "analysis_type"]
    a = analyses.withColumn("claims_run_id", F.coalesce("reused_from_run_id", "run_id"))
    return dealt(a, parts, *keys).join(dealt(claims.withColumnRenamed("run_id", "claims_run_id"), parts, *keys), keys)


def filing_evidence(citations: DataFrame, claims: DataFrame, analyses: DataFrame, parts: int = 1) -> DataFrame:
    """accession, claim_id, run_id, ticker, analysis_type, claim_order, is_current: each claim once for a filing it cites.

    Rows meet in so many ``parts``; those by claim serve the join and what makes them different.
    """
    cited = citations.select("accession", "claim_id")
    known = dealt(claims, parts, *_RUN).join(dealt(analyses.select(*_RUN, "is_current"), parts, *_RUN), _RUN)
    return dealt(cited, parts, "claim_id").join(dealt(known, parts, "claim_id"), "claim_id").select("accession", "claim_id", *_RUN, "claim_order", "is_current").distinct()


def source_filings(shown: DataFrame, citations: DataFrame, filings: DataFrame) -> DataFrame:
    """ticker and the filings that the claims shown to it cite, with their columns; not the newest filing that exists."""
    used = shown.select("ticker", "claim_id").join(citations.select("claim_id", "accession"), "claim_id").select("ticker", "accession").distinct()
    return used.join(filings, "accession")


def newer_inputs(verdicts: DataFrame, **latest: DataFrame) -> DataFrame:
    """ticker, recorded, newer: the names of inputs of which a newer run exists than the verdict was made from.

    Verdicts have ``<name>_run_id`` for each name in latest (ticker, run_id). Nothing is newer where no run was recorded,
    or where there is no run at all.
    """
    out = verdicts
    for name, runs in latest.items():
        out = out.join(runs.select("ticker", F.col("run_id").alias(f"_{name}")), "ticker", "left")
    recorded = F.col(f"{next(iter(latest))}_run_id").isNotNull()
    names = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull() & ~F.col(f"_{n}").eqNullSafe(F.col(f"{n}_run_id")), n) for n in latest]))
    return out.select("ticker", recorded.alias("recorded"), F.when(recorded, names).otherwise(F.array().cast("array<string>")).alias("newer"))


def cached_runs(analyses: DataFrame) -> DataFrame:
    """ticker, cache_key, source_run_id: the oldest run that made an analysis of this input itself (columns created_at too)."""
    own = analyses.where("reused_from_run_id is null and cache_key is not null")
    return own.groupBy("ticker", "cache_key").agg(F.min_by("run_id", F.struct("created_at", "run_id")).alias("source_run_id"))


def copied_forward(analyses: DataFrame, requests: DataFrame) -> DataFrame:
    """All analyses after the requests (run_id, ticker, cache_key, created_at) that the cache can answer.

    A hit copies the source run's rows under the new run and points back to it, and the ticker's earlier rows are no
    longer current. Requests without a hit change nothing; of two of one ticker the later one stays current.
    """
    hits = requests.join(cached_runs(analyses), ["ticker", "cache_key"])
    last = hits.groupBy("ticker").agg(F.max(F.struct("created_at", "run_id"))["run_id"].alias("_newest"))
    new = hits.select("ticker", "source_run_id", F.col("run_id").alias("_run"), F.col("created_at").alias("_at"))
    held = analyses.withColumn("source_run_id", F.col("run_id")).join(new, ["ticker", "source_run_id"])
    replaced = {"run_id": F.col("_run"), "created_at": F.col("_at"), "reused_from_run_id": F.col("source_run_id"), "is_current": F.lit(True)}
    made = held.select(*[replaced.get(c, F.col(c)).alias(c) for c in analyses.columns])
    both = analyses.unionByName(made).join(last, "ticker", "left")
    return both.withColumn("is_current", F.when(F.col("_newest").isNull(), F.col("is_current")).otherwise(F.col("run_id") == F.col("_newest"))).select(*analyses.columns)


def pending(requests: DataFrame, *done: DataFrame) -> DataFrame:
    """Requests (custom_id) that no result file has answered yet; a restart reads the queue from here."""
    for results in done:
        requests = requests.join(results.select("custom_id").distinct(), "custom_id", "left_anti")
    return requests


def fact_versions(facts: DataFrame, keys: list[str], value: str, filed: str, accession: str) -> DataFrame:
    """keys, versions, distinct_values, first_value, last_value, first_accession, last_accession, restated.

    Every filing that reported a figure counts; it is restated once two of them differ. An unknown date comes first.
    """
    at = F.struct(F.coalesce(F.col(filed).cast("string"), F.lit("")), F.col(accession), F.col(value))
    pick = lambda f, c: f(c, at)
    known = facts.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias("versions"), F.count_distinct(value).alias("distinct_values"),
        pick(F.min_by, value).alias("first_value"), pick(F.max_by, value).alias("last_value"),
        pick(F.min_by, accession).alias("first_accession"), pick(F.max_by, accession).alias("last_accession"),
    ).withColumn("restated", F.col("distinct_values") > 1)


def usable_filing(filings: DataFrame, extracted: DataFrame) -> DataFrame:
    """ticker, accession, error: the filing to read, by which sections could be extracted (accession).

    Filings have ticker, accession, form_type, period, filing_date and cached. It is the newest cached one; if that is an
    amendment without sections, the last original of the same period is tried, and no other.
    """
    here = filings.where("cached").join(extracted.select("accession", F.lit(True).alias("ok")).distinct(), "accession", "left")
    newest = top_row(here, ["ticker"], F.desc_nulls_last("period"), F.desc("filing_date"), F.desc("accession"))
    first = newest.select("ticker", "period", F.col("accession").alias("_first"), F.col("ok").alias("_ok"), (F.col("form_type") == "10-K/A").alias("_amended"))
    original = top_row(here.where("form_type = '10-K'"), ["ticker", "period"], F.desc("filing_date"), F.desc("accession")).select("ticker", "period", F.col("accession").alias("_second"), F.col("ok").alias("_ok2"))
    all_ = filings.select("ticker").distinct().join(first, "ticker", "left").join(original, ["ticker", "period"], "left")
    chosen = F.when(F.col("_ok"), F.col("_first")).when(F.col("_amended") & F.col("_ok2"), F.col("_second"))
    return all_.select("ticker", chosen.alias("accession"), F.when(F.col("_first").isNull(), "no filing").when(chosen.isNull(), "extraction failed").alias("error"))


def gap_sections(have: Column) -> Column:
    """Which of the three sections are missing from an array of names; none if the full text is there."""
    needed = F.array(*[F.lit(s) for s in SECTION_TITLES if s != "full"])
    return F.when(F.array_contains(have, "full"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(needed, have)))


def request_documents(sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document_index, section_id, title, document_id: sections (section_id, document_id) in the order sent.

    The index, from 0, is what a reply's citations refer to. Texts stay where they are and join by document_id.
    """
    order = F.array(*[F.lit(s) for s in SECTION_TITLES])
    rank = F.array_position(order, F.col("section_id"))
    listed = sections.where(rank > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "section_id", "document_id"))).alias("_s"))
    titles = F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv])
    rows = listed.select(*keys, F.posexplode("_s").alias("document_index", "_d"))
    return rows.select(*keys, "document_index", "_d.section_id", titles[F.col("_d.section_id")].alias("title"), "_d.document_id")


# The note on sections that can't be cited, and what is asked for.
GAP_NOTE = ("NOTE: The following section(s) are incorporated by reference in this filing and are not available for citation:\n", "\nUse INSUFFICIENT EVIDENCE for any claim that would require them.")
ANALYSIS_REQUEST = ("Analyse ", "'s 10-K for the period ending ", " and produce the four sections (BUSINESS QUALITY, MOAT, MANAGEMENT, RISK) using the format specified in the system prompt.")


def request_texts(have: Column, ticker: Column, period: Column) -> dict[str, Column]:
    """note and request: the texts behind the documents of a request. ``have`` are its sections; the note names those that lack, and is null if none does."""
    titles = F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv])
    lines = F.array_join(F.transform(gap_sections(have), lambda s: F.concat(F.lit("- "), titles[s])), "\n")
    note = F.when(lines != "", F.concat(F.lit(GAP_NOTE[0]), lines, F.lit(GAP_NOTE[1])))
    return {"note": note, "request": F.concat(F.lit(ANALYSIS_REQUEST[0]), ticker, F.lit(ANALYSIS_REQUEST[1]), F.coalesce(period, F.lit("unknown")), F.lit(ANALYSIS_REQUEST[2]))}


def claims_block(claims: DataFrame, keys: list[str], kind: str, order: str, ref: str, claim: str) -> DataFrame:
    """keys, block: a text that lists claims by kind, each with its reference, in order."""
    line = F.struct(F.col(kind).alias("kind"), F.col(order).alias("ord"), F.concat(F.lit("["), F.col(ref), F.lit("] "), F.col(claim)).alias("line"))
    listed = claims.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    kinds = F.array_sort(F.array_distinct(F.transform("_l", lambda x: x["kind"])))
    part = lambda k: F.concat(F.lit("## "), k, F.lit("\n"), F.array_join(F.transform(F.filter("_l", lambda x: x["kind"] == k), lambda x: x["line"]), "\n"))
    return listed.select(*keys, F.array_join(F.transform(kinds, part), "\n\n").alias("block"))


def stitched(quality: Column, bear: Column, valuation: Column, score: Column, status: Column) -> dict[str, Column]:
    """Texts of a brief that are put together from the three readers' verdicts."""
    conclusion = F.concat(
        F.lit("Overall score: "), F.format_string("%.1f", score), F.lit("/100 — "), status, F.lit(".\n\nQuality Analyst: "), quality,
        F.lit("\n\nBear Analyst: "), bear, F.lit("\n\nValuation Analyst: "), valuation,
    )
    return {"investment_thesis": F.concat(quality, F.lit("\n\n"), valuation), "ai_conclusion": conclusion}


def to_monitor(statements: Column) -> Column:
    """A bear case's statements (array of text) as a JSON list."""
    return F.to_json(F.coalesce(statements, F.array().cast("array<string>")))


def stale_analyses(analyses: DataFrame, claims: DataFrame, events: DataFrame, parts: int = 1) -> DataFrame:
    """_RUN, degraded, checked, stale of each analysis with checked citations: stale if the last result of one is fuzzy or unresolved.

    Events, which are only ever added, have claim_id, citation_id, checked_at and result. Claims of a copied analysis are those of the run that it was
    copied from; the flag is that of the analysis shown. Rows meet in so many ``parts``.
    """
    last = dealt(events, parts, "claim_id").groupBy("claim_id", "citation_id").agg(F.max_by("result", "checked_at").alias("result"))
    met = dealt(shown_claims(analyses, claims, parts).select(*_RUN, "claim_id"), parts, "claim_id").join(last, "claim_id")
    bad = F.col("result").isin("fuzzy", "unresolved")
    return met.groupBy(*_RUN).agg(F.count_if(bad).alias("degraded"), F.count("*").alias("checked"), F.bool_or(bad).alias("stale"))
