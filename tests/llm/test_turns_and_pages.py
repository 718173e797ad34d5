"""Prefix trie, page text and structure repair: SQL and brute force on odd tables, and the smallest supplied tables."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from grainledger.llm import html_text, prefix_trie, structure_repair
from grainledger.llm.queries import ORACLE_SQL, QUERIES
from grainledger.llm.turns import numbered

DIR = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, pos long, node long, kind string, part int"


def odd_rows():
    rng = random.Random(5)
    said = ["", None, "  \n", "Yes.", "No", "Why?", "É ü 文!", "long " * 3000, "a\tb.", "Yes. "]
    rows = []
    for c in [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14, 17, 25, -5, -3, 1 << 40, None, *range(100, 160)]:
        for t in range(rng.choice([1, 2, 3, 7, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ua"])
            rows.append((c, rng.choice([t, t, t, None, t + 3]), role, rng.choice(said), 1, 2, "k", 3))
    for c in range(200, 260):  # copies
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.", 1, 2, "k", 3) for t in range(4)]
    rows += [rows[3], rows[3], rows[7]]
    rows += [(777, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(said[3:7]), 0, 0, "k", 0) for t in range(300)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), KIND).repartition(5).write.parquet(f"{where}/conversations.parquet")
    return str(where)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], KIND).write.parquet(f"{where}/conversations.parquet")
    return str(where)


def by_sql(name, where):
    con = duckdb.connect()
    path = f"{where}/conversations.parquet"
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path if where == DIR else path + '/*.parquet'}'")
    got = con.sql(ORACLE_SQL[name])
    return sorted(got.columns), sorted((tuple(dict(zip(got.columns, r))[c] for c in sorted(got.columns)) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_structure_repair"])
def test_sql(spark, odd, name):
    for where in (DIR, odd):
        got = QUERIES[name](spark, where)
        columns, rows = by_sql(name, where)
        assert sorted(got.columns) == columns
        assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == rows


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_structure_repair"])
def test_empty(spark, none, name):
    assert QUERIES[name](spark, none).count() == 0


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([None, *range(9)]), "x") for _ in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = numbered(spark.createDataFrame(rows, "k long, t long, pos2 string").repartition(7), "k", ["t"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in (None, 1, 2, 3):
        own = sorted(((r["pos"], r["t"]) for r in got if r["k"] == k), key=lambda r: r[0])
        assert [p for p, _ in own] == list(range(sum(r[0] == k for r in rows)))
        assert [t for _, t in own] == sorted((r[1] for r in rows if r[0] == k), key=lambda t: (t is not None, t))


def test_trie_by_hand(spark):
    said = {1: "ab", 2: "abc", 3: "ab", 4: "x", 6: ""}
    turns = spark.createDataFrame([(c, p, t.encode(), 2) for c, s in said.items() for p, t in enumerate(s)], "conv_id long, pos long, digest binary, bytes long")
    convs = spark.createDataFrame([(c, len(s)) for c, s in said.items()], "conv_id long, turns long")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, convs).collect()), key=str)
    assert got == sorted([
        (1, 0, None, 5, 2, 2, 8, sha("6")), (1, 1, 1, 3, 1, 1, 8, sha("")), (1, 2, 1, 3, 1, 1, 4, sha("1,3")), (2, 3, 1, 1, 0, 1, 0, sha("2")), (4, 1, 1, 1, 0, 1, 0, sha("4")),
    ], key=str)


# structure repair by trying all


def cheapest(codes):
    """Least (cost, audit), by plain recursion over all edits."""
    moves = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}

    @functools.cache
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(codes) and state in (0, 3) else []
        if inserted < 2:
            c, a = best(i, moves[state][0], inserted + 1)
            ways.append((c + 5, "I" + a))
        if i < len(codes):
            kind, fault = codes[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                c, a = best(i + 1, moves[state][0], 0)
                ways.append((c + 1 + more, "R" + a))
                to = 1 if kind == "s" and state == 0 else moves[state][0] if kind == moves[state][1] else None
                if to:
                    c, a = best(i + 1, to, 0)
                    ways.append((c + more, "K" + a))
        return min(ways, default=(1 << 30, ""))

    return best(0, 0, 0)


def letters(codes):
    return "".join(structure_repair.CODES["suao".index(k) * 4 + f] for k, f in codes)


def total(codes):
    return structure_repair.costs(codes, structure_repair.ENDING)[0][0]


def test_cheapest_edits():
    rng = random.Random(2)
    for _ in range(400):
        codes = [(rng.choice("suao"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 9))]
        assert (total(letters(codes)), structure_repair.walk(letters(codes), structure_repair.ENDING, 0, True)[0]) == cheapest(codes)


def test_pieces_give_what_the_whole_gives(spark, odd):
    turns = structure_repair.damaged(spark.read.parquet(f"{odd}/conversations.parquet"))
    whole, pieces = (sorted((tuple(r) for r in structure_repair.repair(turns, size).collect()), key=str) for size in (4096, 3))
    assert whole == pieces


# pages


PROSE = " ".join(f"Sentence {i} says something of its own." for i in range(12))


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("only text", "only text"), ("<p>a &lt; b &amp; c&nbsp;&eacute;&#33;", "a < b & c é!"),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One <b>b</b>old<br>line<p>{PROSE}</article><footer>Foot</footer>", f"Head One bold line {PROSE}"),
    (f"<body class='page has-sidebar'><div id=top-menu><a href=1>A</a></div><div class=content><h1>H</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div><div id='comments'><p>{PROSE * 9}</p></div>", f"H {PROSE} {PROSE}"),
    (f"<main><div class='cookie-notice'>We use cookies.</div><form><p>Mail</p><input></form><p>{PROSE}</p><aside>More</aside><!-- no <p>x</p> --></main>", PROSE),
    (f"<div><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><h2>S</h2><p>{PROSE}</p><p>{PROSE}</p></div><div><h2>T</h2><p>{PROSE}</p></div></div>", f"S {PROSE} {PROSE} T {PROSE}"),
    (f"<ul><li>{PROSE}<li>{PROSE}</ul><div hidden>secret</div><div style='display: none'>hidden</div>", f"{PROSE} {PROSE}"),
    (f"<article><p title='a > b'>x</p><p>{PROSE}</p><div class='ad'>Buy</div><section id=comments><article><p>{PROSE}</p></article></section></article>", f"x {PROSE}"),
    (f"<div class='site-header'><h1>Site</h1></div><article><h1>H</h1><p>{PROSE}</p></article><ol class='comment-list'><li class='comment'><article><p>{PROSE}</p></article></ol>", f"H {PROSE}"),
    ("<nav><a href=1>Only</a></nav><script>x", ""), ("<p>unclosed <b", "unclosed"), ("a<br/>b<div>c</div>d", "a b c d"),
])
def test_article(page, text):
    assert html_text.article(page) == text


def test_deep_and_long():
    assert html_text.article("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(html_text.article(f"<article>{'<p>word word</p>' * 50_000}</article>")) == 500_000 - 1
    assert html_text.article("<a '" * 20_000) is not None


def plain(page):
    """The text of a generated page's article, by its tags alone."""
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    body = re.sub("</?b>", "", body)
    import html

    return " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split())


def test_pages(spark):
    want = {r["page_id"]: (plain(r["html"]), r["url"]) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["url"], r["n_chars"]) for r in QUERIES["op12_html_text"](spark, DIR).collect()}
    assert got == {k: (t, u, len(t)) for k, (t, u) in want.items()}


def test_odd_pages(spark):
    rows = [(1, "u", "<p>x</p>", "t", 1), (1, "u", "<p>x</p>", "t", 1), (None, None, None, None, None)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, found_text string, n_chars int"))
    assert got.columns == ["text", "n_chars", "page_id", "url", "html", "found_text", "n_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("x", 1, *rows[0])] * 2 + [("", 0, *rows[2])]))
    assert html_text.main_text(spark.createDataFrame([], "html string")).count() == 0
