"""Filing text: normalisation, quotes, claims in model replies, and re-anchoring of citations."""

from __future__ import annotations

import difflib
import math
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions.vectorised import sliced, vectorised
from grainledger.session import cut

#: Context kept beside a quote, the least share of a fuzzy match.
CONTEXT, LEAST_SHARE = 48, 0.60
#: Words of the runs by which documents are found for a passage, the first size that it is long enough for; parts of a frequent run.
RUNS, SALTS, GRAM = (3, 1), 16, 3

_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-")
_QUOTES = {ord("‘"): "'", ord("’"): "'", ord("“"): '"', ord("”"): '"'}
_SPACES = dict.fromkeys(map(ord, "      　"), " ")


class _Text(HTMLParser):
    """Text of a page; blocks end a line, scripts and styles are no text."""

    BLOCKS = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 table section title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _normal(raw: str | None) -> str | None:
    if raw is None:
        return None
    if "<" in raw and ">" in raw:
        page = _Text()
        page.feed(raw)
        page.close()
        raw = "".join(page.out)
    raw = raw.translate(_DASHES | _QUOTES | _SPACES)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in raw.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@sliced("string", pa.string())
def normalise(raw: str | None) -> str | None:
    """Text without tags, with plain dashes, quotes and spaces, lines trimmed and at most one empty line in a row."""
    return _normal(raw)


def occurrences(text: Column, quote: Column) -> Column:
    """Starts, from 0, of all occurrences, overlapping ones too."""
    hits = F.filter(F.sequence(F.lit(0), F.length(text) - F.length(quote)), lambda i: F.substring(text, i + 1, F.length(quote)) == quote)
    return F.when((F.length(quote) > 0) & (F.length(text) >= F.length(quote)), hits).otherwise(F.array().cast("array<int>"))


@vectorised("array<int>")
def find_all(text: pd.Series, quote: pd.Series) -> pd.Series:
    """As ``occurrences``, by the library's substring search: for long texts."""

    def one(t: str | None, q: str | None) -> list[int]:
        out, at = [], (t or "").find(q) if q else -1
        while at >= 0:
            out.append(at)
            at = t.find(q, at + 1)
        return out

    return pd.Series([one(t, q) for t, q in zip(text, quote)])


@vectorised("struct<start:int,end:int,share:double>")
def fuzzy(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """The longest run that text and quote share, as a part of the quote's length."""

    def one(t: str | None, q: str | None) -> tuple:
        if not t or not q:
            return None, None, None
        m = difflib.SequenceMatcher(None, t, q, autojunk=False).find_longest_match(0, len(t), 0, len(q))
        return m.a, m.a + m.size, m.size / len(q)

    return pd.DataFrame([one(t, q) for t, q in zip(text, quote)], columns=["start", "end", "share"])


@vectorised("array<int>")
def _loose(text: pd.Series, quote: pd.Series) -> pd.Series:
    """Starts and ends of matches that may differ in white space, quotes and dashes."""

    def one(t: str | None, q: str | None) -> list[int]:
        words = (q or "").split()
        if not t or not words:
            return []
        plain = lambda w: re.sub(r"[-‐-―−]", "[-‐-―−]", re.sub(r"['‘’]", "['‘’]", re.sub(r'["“”]', '["“”]', re.escape(w).replace("\\-", "-"))))
        return [x for m in re.finditer(r"\s+".join(map(plain, words)), t) for x in m.span()]

    return pd.Series([one(t, q) for t, q in zip(text, quote)])


_ALIKE = ("‘’“”‐‑‒–—―−", "''\"\"-------")


def _words(text: Column) -> Column:
    """Words between white space, with plain quotes and dashes."""
    return F.filter(F.split(F.translate(text, *_ALIKE), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of the different runs of n words."""
    last = lambda w: F.greatest(F.size(w) - n, F.lit(0))
    # the outer array has one element, so that the words are split once and not for each run
    each = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.xxhash64(F.slice(w, i + 1, n)))))
    return F.array_distinct(F.coalesce(each[0], F.array().cast("array<bigint>")))


@vectorised("struct<n:int,need:int>")
def _needed(quote: pd.Series, whole: pd.Series) -> pd.DataFrame:
    """Words of a run, and how many different runs a document with the quote must hold; 0 words where none is sure.

    A first or last word may be a part of a longer one, so only runs between them count. With ``whole`` all are needed,
    else those that no part of the least share can do without.
    """

    def one(q: str, whole: bool) -> tuple[int, int]:
        q = q.translate(str.maketrans(*_ALIKE))
        inner = [m.span() for m in re.finditer(r"[^\s\x1c-\x1f]+", q)][1:-1]
        size = math.ceil(LEAST_SHARE * len(q) - 1e-9)
        for n in RUNS:
            runs = [(tuple(q[a:b] for a, b in inner[i : i + n]), inner[i][0] - 1, inner[i + n - 1][1] + 1) for i in range(len(inner) - n + 1)]
            need = len({r for r, _, _ in runs}) if whole else min(len({r for r, a, b in runs if at <= a and b <= at + size}) for at in range(len(q) - size + 1))
            if need:
                return n, need
        return 0, 0

    return pd.DataFrame([one(q, w) for q, w in zip(quote, whole)], columns=["n", "need"])


@vectorised("array<string>")
def _grams(text: pd.Series, sizes: pd.Series) -> pd.Series:
    """The different runs of so many characters."""
    return pd.Series([[] if t is None else sorted({t[i : i + n] for n in own for i in range(len(t) - n + 1)}) for t, own in zip(text, sizes)])


def _short(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, quote: documents that hold the first GRAM characters of a passage, all of it if it is shorter."""
    keys = quotes.where("quote <> ''").select("quote", F.substring("quote", 1, GRAM).alias("gram"))
    sizes = [r["n"] for r in keys.select(F.length("gram").alias("n")).distinct().collect()]  # GRAM rows at most
    everywhere = documents.select("doc_id").crossJoin(F.broadcast(quotes.where("quote = ''").select("quote")))  # one row at most
    if not sizes:
        return everywhere
    held = documents.select("doc_id", F.explode(_grams("text", F.array(*map(F.lit, sizes)))).alias("gram"))
    return held.join(keys, "gram").select("doc_id", "quote").distinct().union(everywhere)


def _pairs(documents: DataFrame, passages: DataFrame, whole: bool) -> DataFrame:
    """doc_id, text, quote, n, need and runs: every document with every different passage that it can hold.

    Of a passage's runs of words, of which a document needs some, only the rarest are looked up, so many that a document
    without any of them lacks too many. Passages too short for a sure run, of one or two words, are met by their first characters, or,
    where a part of them is enough, tried with every document.
    """
    quotes = passages.where("quote is not null").select("quote").distinct().select("quote", _needed("quote", F.lit(whole)).alias("_n")).select("quote", "_n.*")
    words = _words(F.col("quote"))
    runs = F.array().cast("array<bigint>")
    for n in RUNS:
        runs = F.when(F.col("n") == n, _runs(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), n)).otherwise(runs)
    quotes = cut(quotes.withColumn("runs", runs))
    kinds = [r["n"] for r in quotes.select("n").distinct().collect()]  # 0 and RUNS at most
    sizes, short = [n for n in kinds if n], quotes.where("n = 0").select("quote")
    met = None
    if sizes:
        wanted = quotes.where("n > 0").select("quote", (F.lit(1) if whole else F.size("runs") - F.col("need") + 1).alias("keys"), F.explode("runs").alias("run"))
        own = F.concat(*[_runs(_words(F.col("text")), n) for n in sizes])
        held = cut(documents.select("doc_id", F.explode(own).alias("run")).join(wanted.select("run").distinct(), "run", "left_semi"))
        often = held.groupBy("run").agg(F.count("*").alias("often"))
        rank = F.row_number().over(W.partitionBy("quote").orderBy(F.coalesce("often", F.lit(0)), "run"))
        keys = wanted.join(often, "run", "left").withColumn("rank", rank).where("rank <= keys and often > 0").select("quote", "run", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(keys, ["run", "salt"]).select(F.col("doc_id").alias("_doc"), "quote").distinct()
    if 0 in kinds:
        few = (_short(documents, short) if whole else documents.select("doc_id").crossJoin(short)).select(F.col("doc_id").alias("_doc"), "quote").distinct()
        met = few if met is None else met.unionByName(few)
    if met is None:
        met = documents.limit(0).select(F.col("doc_id").alias("_doc"), F.lit("").alias("quote"))
    return documents.join(met, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(quotes, "quote").select("doc_id", "text", "quote", "n", "need", "runs")


def quoted(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, text, item_id, quote: the passages (item_id, quote) with the documents (doc_id, text) that contain them."""
    found = _pairs(documents, passages, True).where(F.contains(F.col("text"), F.col("quote"))).select("doc_id", "text", "quote")
    return found.join(passages, "quote").select("doc_id", "text", "item_id", "quote")


def fuzzy_quoted(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, share: the longest run that they share, where it is the least share of the passage or
    the document holds the passage but for white space, quotes and dashes."""
    pairs = _pairs(documents, passages, False).where("text is not null")
    shared = F.lit(0)
    for n in RUNS:
        shared = F.when(F.col("n") == n, F.size(F.array_intersect(_runs(_words(F.col("text")), n), F.col("runs")))).otherwise(shared)
    near = pairs.where(shared >= F.col("need")).select("doc_id", "quote", fuzzy("text", "quote").alias("f"), _loose("text", "quote").alias("_at"))
    return near.where((F.col("f.share") >= LEAST_SHARE) | (F.size("_at") > 0)).join(passages, "quote").select("doc_id", "item_id", "f.*")



def re_anchor(citations: DataFrame) -> DataFrame:
    """Where each citation's quote stands now: columns citation_id, result, new_section, new_start, new_end.

    ``citations`` has citation_id, quote, start, prefix, suffix, section, text (of its section, now) and others
    (array of struct<section, text>). Rungs, first that holds: exact, moved, other_section, renormalised, fuzzy, unresolved.
    A quote that occurs several times is only taken where one occurrence alone has the known context.
    """
    c = citations.withColumn("_n", F.length("quote"))
    exact = F.substring("text", F.col("start") + 1, F.col("_n")) == F.col("quote")

    def by_context(text: Column, at: Column) -> Column:
        fits = F.filter(at, lambda i: (F.substring(text, F.greatest(i - F.length("prefix") + 1, F.lit(1)), F.least(F.length("prefix"), i)) == F.col("prefix")) & (F.substring(text, i + F.col("_n") + 1, F.length("suffix")) == F.col("suffix")))
        return F.when(F.size(at) == 1, at[0]).when(F.size(fits) == 1, fits[0])

    c = c.withColumn("_at", find_all("text", "quote"))
    moved = by_context(F.col("text"), F.col("_at"))
    hits = c.select("citation_id", "quote", "prefix", "suffix", "_n", F.inline_outer("others").alias("o_section", "o_text")).where("o_text is not null").withColumn("_at", find_all("o_text", "quote"))
    hits = hits.withColumn("o_start", by_context(F.col("o_text"), F.col("_at"))).where("o_start is not null")
    one = hits.groupBy("citation_id").agg(F.count("*").alias("_k"), F.min("o_section").alias("o_section"), F.min("o_start").alias("o_start")).where("_k = 1").drop("_k")
    c = c.join(one, "citation_id", "left")
    # only what the first rungs leave open is searched loosely, and only what that leaves open for its longest run
    open_ = ~F.coalesce(exact, F.lit(False)) & moved.isNull() & F.col("o_start").isNull()
    c = c.withColumn("_loose", F.when(open_, _loose(F.when(open_, F.col("text")), "quote")))
    still = open_ & (F.size("_loose") != 2)
    c = c.withColumn("_fuzzy", F.when(still, fuzzy(F.when(still, F.col("text")), "quote")))
    spot = lambda name, section, start, end: F.struct(F.lit(name).alias("result"), section.cast("string").alias("new_section"), start.cast("int").alias("new_start"), end.cast("int").alias("new_end"))
    here, none = F.col("section"), F.lit(None)
    found = F.coalesce(
        F.when(exact, spot("exact", here, F.col("start"), F.col("start") + F.col("_n"))),
        F.when(moved.isNotNull(), spot("moved", here, moved, moved + F.col("_n"))),
        F.when(F.col("o_start").isNotNull(), spot("other_section", F.col("o_section"), F.col("o_start"), F.col("o_start") + F.col("_n"))),
        F.when(F.size("_loose") == 2, spot("renormalised", here, F.get("_loose", F.lit(0)), F.get("_loose", F.lit(1)))),
        F.when(F.col("_fuzzy.share") >= LEAST_SHARE, spot("fuzzy", here, F.col("_fuzzy.start"), F.col("_fuzzy.end"))),
        spot("unresolved", none, none, none),
    )
    return c.select("citation_id", found.alias("_f")).select("citation_id", "_f.*")


_CITATION = "struct<document_index:int,start_char:int,end_char:int,cited_text:string>"
_CLAIM = f"array<struct<section:string,ordinal:int,claim:string,status:string,citations:array<{_CITATION}>>>"
_CITED = pa.struct([("document_index", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("cited_text", pa.string())])
_CLAIMS = pa.list_(pa.struct([("section", pa.string()), ("ordinal", pa.int32()), ("claim", pa.string()), ("status", pa.string()), ("citations", pa.list_(_CITED))]))
# The headings of a reply with the names of their sections, the two prefixes, the line that ends a section.
REPLY_SECTIONS = {"BUSINESS QUALITY": "business_quality", "MOAT": "moat", "MANAGEMENT": "management", "RISK": "risk"}
CLAIM, LACKING = "claim:", "insufficient evidence:"
_MARKER = re.compile(rf"##\s+({'|'.join(REPLY_SECTIONS)})\b[^\n]*|({LACKING}|{CLAIM})", re.I)
_RULE = re.compile(r"\n*-{3,}\s*\Z")


class _Reply:
    """Claims of a reply while its blocks are read: which section is open, and whether a claim was announced and still has no text."""

    def __init__(self):
        self.section, self.waiting, self.found, self.counts = None, False, [], {}

    def add(self, text: str, status: str, citations: list[dict]) -> None:
        text = _RULE.sub("", text).rstrip()
        if self.section and text:
            n = self.counts[self.section] = self.counts.get(self.section, 0) + 1
            self.found.append({"section": self.section, "ordinal": n, "claim": text, "status": status, "citations": citations})
            self.waiting = False

    def block(self, text: str, cited: bool, citations: list[dict]) -> None:
        marks = list(_MARKER.finditer(text))
        lead = text[: marks[0].start() if marks else len(text)].strip()
        if cited and marks:
            self.waiting = False  # what stands before the first mark can't be bound to the claim that waits
        elif cited:
            if lead and self.waiting:
                self.add(lead, "asserted", citations)
            else:
                self.waiting = False
        elif lead and self.waiting:
            self.add(lead, "asserted", [])
        for m, end in zip(marks, [n.start() for n in marks[1:]] + [len(text)]):
            body = text[m.end() : end].strip()
            if m[1]:
                self.section = REPLY_SECTIONS[m[1].upper()]
                self.waiting &= cited
            elif m[2].lower() == LACKING:
                self.add(body, "insufficient_evidence", [])
            elif body:
                self.add(body, "asserted", citations if cited else [])
            else:
                self.waiting = True


def _claims(blocks) -> list[dict]:
    reply = _Reply()
    for block in blocks if blocks is not None else []:
        if block["type"] == "text":
            given = block["citations"] if block["citations"] is not None else []
            kept = [{"document_index": c["document_index"], "start_char": c["start_char_index"], "end_char": c["end_char_index"], "cited_text": c["cited_text"]} for c in given if c["type"] == "char_location"]
            reply.block(block["text"] or "", len(given) > 0, kept)
    return reply.found


@sliced(_CLAIM, _CLAIMS)
def claims(blocks: list[dict] | None) -> list[dict]:
    """Claims of replies, arrays of (type, text, citations of (type, document_index, start_char_index, end_char_index, cited_text)).

    A heading opens a section; text outside one makes no claim. A claim's text follows its prefix, or is the next block. A cited block
    is the text of the claim that waits; one with prefixes or headings of its own gives its citations to the claims that it announces itself. Status:
    asserted or insufficient_evidence, which has no citations. Null, empty and other blocks say nothing.
    """
    return _claims(blocks)


def reply_issues(replies: DataFrame, found: DataFrame, unresolved: DataFrame) -> DataFrame:
    """reply_id, code, section, ordinal: why a reply can't be stored; a sound one gives no row.

    ``replies`` has reply_id and stop_reason, ``found`` reply_id, section, ordinal, status, citations, ``unresolved`` (errors of
    ``resolved_citations``) reply_id, section, ordinal and error. Codes: truncated, missing_section, uncited, and those errors.
    """
    none = [F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("ordinal")]
    cut_off = replies.where("stop_reason = 'max_tokens'").select("reply_id", F.lit("truncated").alias("code"), *none)
    wanted = replies.select("reply_id", F.explode(F.array(*map(F.lit, REPLY_SECTIONS.values()))).alias("section"))
    missing = wanted.join(found.select("reply_id", "section").distinct(), ["reply_id", "section"], "left_anti").select("reply_id", F.lit("missing_section").alias("code"), "section", none[1])
    uncited = found.where((F.col("status") == "asserted") & (F.size("citations") == 0)).select("reply_id", F.lit("uncited").alias("code"), "section", "ordinal")
    wrong = unresolved.where("error is not null").select("reply_id", F.col("error").alias("code"), "section", "ordinal")
    return cut_off.unionByName(missing).unionByName(uncited).unionByName(wrong)


def resolved_citations(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Cited claims against their documents: found, or why not: unknown_document, out_of_range, text_differs.

    ``found`` has claim_id, document_id, start_char, end_char, cited_text; ``documents`` has document_id and text.
    """
    met = found.join(documents, "document_id", "left")
    span = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    error = (
        F.when(F.col("text").isNull(), "unknown_document").when((F.col("start_char") < 0) | (F.col("end_char") <= F.col("start_char")) | (F.col("end_char") > F.length("text")), "out_of_range")
        .when(span != F.col("cited_text"), "text_differs")
    )
    low = F.greatest(F.col("start_char") - CONTEXT, F.lit(0))
    return met.select(
        "claim_id", "document_id", "start_char", "end_char", error.alias("error"), F.sha2("cited_text", 256).alias("quote_sha256"),
        F.when(error.isNull(), F.substring("text", low + 1, F.col("start_char") - low)).alias("prefix"), F.when(error.isNull(), F.substring("text", F.col("end_char") + 1, F.lit(CONTEXT))).alias("suffix"),
    )


def coverage(cited: Column, asserted: Column) -> Column:
    """Share of asserted claims that are cited; 1 where none is asserted."""
    return F.when(asserted == 0, 1.0).otherwise(cited / asserted)
