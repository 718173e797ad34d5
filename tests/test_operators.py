"""Cases with known answers for operators that the supplied tables can't show."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainledger.functions import measures
from grainledger.operators import committee, evaluation, facts, lineage, series, text, upsert
from grainledger.plans import relating
from grainledger.sources import readers, versions
from grainledger.streaming import incremental


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_annual_entries_and_rows(spark):
    def fact(tag, unit, end, val, start=None, filed="2021-02-01", form="10-K"):
        return ("1", tag, unit, 0, start is not None, start, end, float(val), "a", form, filed)

    year = [("350", "2019-01-15"), ("380", "2018-12-16"), ("349", "2019-01-16"), ("381", "2018-12-15")]
    rows = [fact("Sales", "USD", "2019-12-31", i, start, form="10-K") for i, (_, start) in enumerate(year)]
    rows += [fact("NetIncome", "USD", "2019-12-31", 7, "2019-01-01"), fact("NetIncome", "USD", "2019-12-31", 9, "2019-01-01", filed="2022-02-01"), fact("Sales", "USD", "2019-06-30", 5, "2019-04-01"), fact("Equity", "USD", "2019-12-31", 3), fact("Equity", "USD", "2019-12-31", 4, "2019-12-31")]
    long = spark.createDataFrame(rows, "cik string, tag string, unit string, ord int, has_start boolean, start string, end string, val double, accn string, form string, filed string")
    long = long.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end")).withColumn("filed", F.to_date("filed"))
    registry = spark.createDataFrame([("revenue", 1, "Sales", "USD", "duration"), ("net_income", 1, "NetIncome", "USD", "duration"), ("equity", 1, "Equity", "USD", "instant")], "metric string, priority int, tag string, unit string, kind string")
    entries = facts.annual_entries(long, registry)
    got = values(entries, "metric", "val")
    assert ("net_income", 9.0) in got and ("equity", 3.0) in got and len(got) == 3
    assert dict(got)["revenue"] in (0.0, 1.0)  # only the periods of 350 and 380 days count
    assert values(facts.annual_rows(facts.by_priority(entries)), "fiscal_year", "net_income", "equity") == [(2019, 9.0, 3.0)]


def test_long_facts_from_json(spark, tmp_path):
    entry = {"start": "2019-01-01", "end": "bad", "val": 1.0, "accn": "x", "form": "10-K", "filed": "2020-01-01", "fy": 2019, "fp": "FY"}
    (tmp_path / "c.json").write_text(json.dumps({"cik": "1", "facts": {"us-gaap": {"Sales": {"units": {"USD": [entry, entry | {"end": "2019-12-31"}]}}}}}))
    got = facts.long_facts(readers.fresh_json(spark, str(tmp_path), facts.COMPANY_FACTS))
    assert [(r["ord"], str(r["end"])) for r in got.orderBy("ord").collect()] == [(0, "None"), (1, "2019-12-31")]


def test_latest_report(spark):
    cases = {"none": [], "original": [("a", "10-K", "2020-12-31", "2021-02-01")], "amended": [("a", "10-K", "2020-12-31", "2021-02-01"), ("b", "10-K/A", "2020-12-31", "2021-03-01"), ("c", "10-K", "2019-12-31", "2022-01-01")], "blank": [("a", "10-K", "", "2021-02-01")]}
    rows = [(k, {"recent": {n: [x[i] for x in v] for i, n in enumerate(("accessionNumber", "form", "reportDate", "filingDate"))}}) for k, v in cases.items()]
    kind = "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, reportDate: array<string>, filingDate: array<string>>>"
    got = {r["cik"]: (r["accn"], r["fallback"]) for r in facts.latest_annual_report(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"original": ("a", None), "amended": ("b", "a")}


def test_split_factor_needs_confirmation(spark):
    df = spark.createDataFrame([("a", 2018, 10.0), ("a", 2019, 30.0), ("a", 2020, 42.0), ("b", 2018, 10.0), ("b", 2019, 30.0)], "ticker string, year int, shares double")
    confirmed = spark.createDataFrame([("a", 2019), ("a", 2020)], "ticker string, year int")
    got = {(r["ticker"], r["year"]): r["factor"] for r in series.split_factors(df, ["ticker"], "year", "shares", confirmed).collect()}
    assert got[("a", 2020)] == 1.0 and got[("a", 2019)] == pytest.approx(1.4) and got[("a", 2018)] == pytest.approx(4.2)
    assert got[("b", 2018)] == 1.0


def test_as_of(spark):
    prices = spark.createDataFrame([("a", "2020-01-02", 1.0), ("a", "2020-01-05", 2.0)], "k string, d string, close double").withColumn("d", F.to_date("d"))
    probes = spark.createDataFrame([("a", 1, "2020-01-01"), ("a", 2, "2020-01-02"), ("a", 3, "2020-01-04"), ("a", 4, None), ("b", 5, "2020-01-09")], "k string, n int, p string").withColumn("p", F.to_date("p"))
    assert sorted((r["n"], r["close"]) for r in series.as_of(probes, prices, "k", "p", "d", "close").collect()) == [(1, None), (2, 1.0), (3, 1.0), (4, None), (5, None)]


def test_opening_band(spark):
    rows = [("a", "2020-12-31", 9.0), *[(f"d{n}", None, 0.0) for n in ()]]
    days = {"329": "2020-02-06", "330": "2020-02-05", "365": "2020-01-01", "400": "2019-11-27", "401": "2019-11-26"}
    for n, d in days.items():
        rows += [(n, "2020-12-31", 9.0), (n, d, float(n))]
    df = spark.createDataFrame(rows, "k string, d string, v double").withColumn("d", F.to_date("d"))
    got = {r["k"]: r["opening"] for r in series.opening_value(df, ["k"], "d", "v").where("d = '2020-12-31'").collect()}
    assert got == {"a": None, "329": None, "330": 330.0, "365": 365.0, "400": 400.0, "401": None}


def test_measures(spark):
    row = spark.range(1).select(
        measures.debt_to_fcf(F.lit(-1.0), F.lit(None).cast("double")).alias("a"), measures.debt_to_fcf(F.lit(1.0), F.lit(0.0)).alias("b"), measures.margin_of_safety(F.lit(0.0), F.lit(5.0)).alias("c"), measures.margin_of_safety(F.lit(2.0), F.lit(5.0)).alias("d"),
        measures.growth_rate(F.lit(1.0), F.lit(2000), F.lit(-1.0), F.lit(2002)).alias("e"), measures.owner_earnings(F.lit(5.0), F.lit(1.0), F.lit(2.0), F.lit(None).cast("double")).alias("f"), measures.owner_earnings(F.lit(5.0), F.lit(None).cast("double"), F.lit(2.0), F.lit(1.0)).alias("g"),
        measures.weekdays_between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-08").cast("date")).alias("h"), measures.basis_change(F.lit(1.0), F.lit(3.0)).alias("i"), measures.basis_change(F.lit(1.0), F.lit(1000.0)).alias("j"), measures.basis_change(F.lit(1.0), F.lit(1.2)).alias("k"),
        measures.two_stage_value(F.lit(100.0), F.lit(0.0), F.lit(0.1), F.lit(0.0)).alias("l"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h) == (0.0, None, None, -1.5, None, 4.0, None, 0)
    assert (row.i, row.j, row.k) == ("split", "unit_correction", None) and row.l == pytest.approx(1000.0)
    with pytest.raises(Exception, match="terminal growth"):
        spark.range(1).select(measures.two_stage_value(F.lit(1.0), F.lit(0.0), F.lit(0.05), F.lit(0.05))).collect()


def test_re_anchor(spark):
    long = "the quick brown fox jumps over the lazy dog"
    kind = "citation_id int, quote string, start int, prefix string, suffix string, section string, text string, others array<struct<section:string,text:string>>"
    rows = [
        (1, "brown fox", 10, "quick ", " jumps", "1", long, []), (2, "brown fox", 3, "quick ", " jumps", "1", long, []), (3, "brown fox", 3, "", "", "1", "nothing", [("7", long)]),
        (4, "brown  fox", 3, "", "", "1", long, []), (5, "brown fox jump!", 3, "", "", "1", long, []), (6, "zebra", 3, "", "", "1", long, []), (7, "the", 5, "over ", " lazy", "1", long, []), (8, "the", 5, "?", "?", "1", long, []),
    ]
    got = {r["citation_id"]: (r["result"], r["new_start"]) for r in text.re_anchor(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["exact", "moved", "other_section", "renormalised", "fuzzy", "unresolved", "moved"]
    assert got[7][1] == 31 and got[2][1] == 10 and got[8][0] == "fuzzy"


def test_occurrences_overlap(spark):
    row = spark.createDataFrame([("aaaa", "aa"), ("", "a"), ("a", "")], "t string, q string").select(text.occurrences(F.col("t"), F.col("q")).alias("a"), text.find_all("t", "q").alias("b")).collect()
    assert [list(r.a) for r in row] == [list(r.b) for r in row] == [[0, 1, 2], [], []]


def test_claims(spark):
    cite = [("char_location", 0, 0, 4, "word")]
    other = [("page_location", 0, 0, 4, "word")]
    blocks = {
        "waits for a cited block": [("CLAIM: lost\n## MOAT\n\nCLAIM: ", []), ("First\n---\n", cite), ("CLAIM: Second", []), ("INSUFFICIENT EVIDENCE: third\n\n----\n", [])],
        "waits for a plain block": [("## risk and more\nclaim:", []), ("text of it", []), ("not a claim", [])],
        "cited without a claim": [("## MOAT", []), ("no prefix", cite), ("CLAIM:", []), ("", cite), ("too late", [])],
        "compound": [("## MOAT\nCLAIM: ", []), ("tail of none CLAIM: inner ## RISK x\nCLAIM: next INSUFFICIENT EVIDENCE: none CLAIM: ", cite), ("body", cite)],
        "a heading ends waiting": [("## MOAT\nCLAIM: ## RISK\nafter", []), ("cited", cite)],
        "unknown heading": [("## OTHER\nCLAIM: x", []), ("## MANAGEMENT CLAIM: same line\nCLAIM: y", [])],
        "other citations": [("## BUSINESS  QUALITY\n## Business Quality\nCLAIM: ", []), ("z", other)],
        "nothing": [(None, None), ("", [])],
    }
    kind = "id string, b array<struct<type:string,text:string,citations:array<struct<type:string,document_index:int,start_char_index:int,end_char_index:int,cited_text:string>>>>"
    df = spark.createDataFrame([(k, [("text", t, c) for t, c in v] + [("tool", "CLAIM: no", [])]) for k, v in blocks.items()] + [("null", None)], kind)
    got = {}
    for r in df.select("id", F.inline(text.claims("b"))).collect():
        got.setdefault(r["id"], []).append((r["section"], r["ordinal"], r["claim"], r["status"][0], len(r["citations"])))
    assert got == {
        "waits for a cited block": [("moat", 1, "First", "a", 1), ("moat", 2, "Second", "a", 0), ("moat", 3, "third", "i", 0)],
        "waits for a plain block": [("risk", 1, "text of it", "a", 0)],
        "compound": [("moat", 1, "inner", "a", 1), ("risk", 1, "next", "a", 1), ("risk", 2, "none", "i", 0), ("risk", 3, "body", "a", 1)],
        "unknown heading": [("management", 1, "y", "a", 0)],
        "other citations": [("business_quality", 1, "z", "a", 0)],
    }


def test_normalise(spark):
    df = spark.createDataFrame([("<p>A&nbsp;&ldquo;b&rdquo;</p><script>x</script><p>c — d</p>",), (None,)], "h string")
    assert [r[0] for r in df.select(text.normalise("h")).collect()] == ['A "b"\n\nc - d', None]


def test_persona_replies(spark):
    lines = lambda *refs: "## STATEMENTS\n" + "\n".join(f"STATEMENT: said {i}" + (f" [refs: {r}]" if r else "") for i, r in enumerate(refs))
    quality = "## VERDICT\nfine\n## SCORES\nBUSINESS_QUALITY: 80\nCOMPETITIVE_MOAT: 70.5\nMANAGEMENT: 60\nRISK: 5\n"
    bear = "## Verdict\nso so\n## Scores\nRISK: 140\nseverity: High\n"
    cases = {
        "good": ("quality", quality + lines("1, 02", "", "1", "2"), []), "few": ("quality", quality + lines("1"), ["few_statements"]), "many": ("bear", bear + lines(*[""] * 9), ["out_of_range:RISK", "many_statements"]),
        "refs": ("quality", quality + lines("roic", "7", "1", ""), ["not_a_number:roic", "unknown_ref:7"]), "figures": ("valuation", "## VERDICT\nok\n## SCORES\nVALUATION: 50\nFINANCIAL_STRENGTH: 40\n" + lines("DCF bear", "", "", "9"), ["unknown_ref:9"]),
        "none": ("bear", None, ["no_verdict", "no_score:RISK", "no_severity", "few_statements"]),
    }
    df = spark.createDataFrame([(k, p, raw) for k, (p, raw, _) in cases.items()], "ticker string, persona string, raw string")
    known = spark.createDataFrame([(k, ["1", "2"]) for k in cases if k != "none"], "ticker string, refs array<string>")
    got = {r["ticker"]: r for r in committee.persona_replies(df, known, ["ticker"]).collect()}
    assert {k: r["errors"] for k, r in got.items()} == {k: e for k, (_, _, e) in cases.items()}
    assert got["good"]["scores"] == {"business": 80.0, "moat": 70.5, "management": 60.0} and got["many"]["scores"] == {"risk": 100.0} and got["many"]["severity"] == "high"


def test_status_and_errors(spark):
    df = spark.createDataFrame([(70.0, "low"), (70.0, "high"), (69.99, "low"), (49.99, "low")], "s double, v string")
    assert [r[0] for r in df.select(evaluation.verdict_status(F.col("s"), F.col("v"))).collect()] == ["investigate", "watch", "watch", "reject"]
    with pytest.raises(Exception, match="unknown severity"):
        spark.createDataFrame([(70.0, "odd")], "s double, v string").select(evaluation.verdict_status(F.col("s"), F.col("v"))).collect()


def test_bootstrap(spark):
    df = spark.createDataFrame([(float(i % 10), f"s{i % 3}") for i in range(60)] + [(1.0, "tiny")], "v double, s string")
    one, two = (evaluation.bootstrap_interval(df, "v", "s", 500).first() for _ in range(2))
    assert one == two and one["n"] == 61 and one["low"] < one["mean"] < one["high"] and one["method"] == "unstratified_small_sector_fallback"
    few = evaluation.bootstrap_interval(df.limit(10), "v", "s", 50).first()
    assert few["low"] is None and few["method"] is None and few["n"] == 10
    assert evaluation.bootstrap_interval(df.limit(0), "v", "s", 50).first()["n"] == 0


def test_bootstrap_in_pieces(spark):
    rows = [((i * 37 % 101) / 7.0, "a" if i % 3 else "b") for i in range(900)] + [(5.0, None), (6.0, ""), (7.0, "c"), (8.0, "d"), (9.0, "e")]
    df = spark.createDataFrame(rows, "v double, s string")
    terms = {"total": F.col("v"), "n": F.lit(1), "a": F.when(F.col("s") == "a", 1)}
    mean = lambda t: F.try_divide(t["total"], t["n"])
    got = {p: evaluation.bootstrap(df, "s", terms, mean, 3000, 5, p).first() for p in (7, 4096)}
    want = sum(v for v, _ in rows) / len(rows)
    strata = [[v for v, s in rows if s == "a"], [v for v, s in rows if s == "b"], [v for v, s in rows if s not in ("a", "b")]]
    error = sum(sum((v - sum(x) / len(x)) ** 2 for v in x) for x in strata) ** 0.5 / len(rows)
    for r in got.values():
        assert r["method"] == "sector_stratified_with_pooled_small_sectors" and r["replicates"] == 3000 and abs(r["estimate"] - want) < 1e-9
        assert abs((r["high"] - r["low"]) / (2 * 1.96 * error) - 1) < 0.08 and abs((r["high"] + r["low"]) / 2 - want) < 0.2 * error
    # sizes of strata and of the whole don't vary
    for key, n in (("n", 905), ("a", 600)):
        r = evaluation.bootstrap(df, "s", terms, lambda t, key=key: t[key], 200, 5, 7).first()
        assert r["low"] == r["high"] == r["estimate"] == n
    assert evaluation.bootstrap(df, "s", terms, lambda t: F.try_divide(t["total"], t["n"] * 0), 100, 5).first()["low"] is None
    plain = df.where("s in ('a', 'b')")
    assert evaluation.bootstrap(plain, "s", terms, mean, 100, 5).first()["method"] == "sector_stratified"


def test_percentiles_and_ranks_in_parts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1.5, 2.5, *[rng.random() * 9 for _ in range(4)]])) for _ in range(900)] + [("few", 1.0)] * 4
    df = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    w = W.partitionBy("g", F.col("v").isNotNull())
    known = F.col("v").isNotNull()
    want = df.select(
        "id", *[F.when(known & F.col("g").isNotNull() & (F.count("*").over(w) >= 5), 100 * F.cume_dist().over(w.orderBy(o))) for o in (F.asc("v"), F.desc("v"))],
        F.when(known, F.rank().over(w.orderBy("v")) + (F.count("*").over(W.partitionBy("g", "v")) - 1) / 2),
    )
    got = series.average_ranks(series.peer_percentiles(series.peer_percentiles(df, ["g"], "v", "up"), ["g"], "v", "down", False), "v", ["g"], "rank").select("id", "up", "down", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    total = series.value_counts(df, [], "v", 4).agg(F.max("upto"), F.max("total"), F.sum("n")).first()
    assert total[0] == total[1] == total[2] == sum(v is not None for _, v in rows)
    assert series.value_counts(df.limit(0), ["g"], "v").count() == 0


def test_chain_with_cycle(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "run string, parent string")
    got = {r["run"]: (r["root"], r["hops"]) for r in lineage.chain_roots(links, "run", "parent").collect()}
    assert got["c"] == ("a", 2) and got["a"] == ("a", 0) and got["x"] == (None, None) and got["z"][0] == "gone"


def test_strict_records(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in [{"ticker": "A", "v": 1}, {"ticker": "B", "v": 1, "odd": 2}, {"v": 2}, {"ticker": "C", "v": 1}, {"ticker": "C", "v": 2}]) + "\nnot json\n")
    good, issues = readers.strict_records(spark, str(tmp_path / "b.jsonl"), ["ticker"], ["v"], ["v"])
    assert [r["ticker"] for r in good.collect()] == ["A"]
    assert values(issues, "code") == [("duplicate",), ("duplicate",), ("missing_key",), ("unknown_key",), ("unparsable",)]


def test_replace_run_with_null_key(spark):
    old = spark.createDataFrame([("r1", None, 1), ("r1", "bear", 1), ("r2", None, 1)], "run string, scenario string, v int")
    new = spark.createDataFrame([("r1", None, 2), ("r1", "bear", 2)], "run string, scenario string, v int")
    assert sorted(r["v"] for r in upsert.replace_run(old, new, ["run", "scenario"]).collect()) == [1, 2, 2]


def test_stream_merges_like_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 1, 3), ("a", 2, 4)], "k string, t int, v int")
    for i in range(2):
        rows.where(f"v % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.merge_latest(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k"], "t", "v").awaitTermination()
    assert values(versions.merged(spark, str(tmp_path / "out"), ["k"], ["t", "v"]), "k", "t", "v") == values(series.top_row(rows, ["k"], F.desc("t"), F.desc("v")), "k", "t", "v")


def test_new_prices(spark):
    kind = "ticker string, date string, close double"
    stored = spark.createDataFrame([("a", "2020-01-02", 1.0)], kind)
    batch = spark.createDataFrame([("a", "2020-01-02", 1.0), ("a", "2020-01-03", 2.0), ("b", "2020-01-01", 3.0)], kind)
    assert values(incremental.new_prices(batch, stored), "ticker", "date") == [("a", "2020-01-03"), ("b", "2020-01-01")]
    assert incremental.new_prices(stored, stored).count() == 0
    with pytest.raises(ValueError):
        incremental.new_prices(stored.limit(0), stored)


def test_quoted_passages(spark):
    said = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"so {said} it is"), (2, f"so {said.replace(' ', chr(10))} it is"), (3, f"so {said.replace('beta', 'other')} it is"), (4, "x" + said + "y"), (5, "alpha beta gamma and no more"), (6, None), (None, said), (7, "a kappab"), (7, said)]
    docs = spark.createDataFrame(docs, "doc_id int, text string")
    passages = spark.createDataFrame([(1, said), (2, said), (3, "kappa"), (4, "zeta eta theta"), (5, ""), (6, None), (7, "eta theta")], "item_id int, quote string")
    whole = sorted(((d["doc_id"], p["item_id"]) for d in docs.collect() for p in passages.collect() if d["text"] is not None and p["quote"] is not None and p["quote"] in d["text"]), key=str)
    assert sorted((tuple(r) for r in text.quoted(docs, passages).select("doc_id", "item_id").collect()), key=str) == whole
    got = {r["doc_id"]: r for r in text.fuzzy_quoted(docs, passages.where("item_id = 1")).collect()}
    assert set(got) == {1, 2, 3, 4, None, 7}
    assert got[1]["share"] == 1.0 and got[1]["start"] == 3 and got[3]["share"] < 1 and got[2]["share"] < text.LEAST_SHARE


def test_many_passages(spark, tmp_path):
    said = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), *[F.concat(F.lit(f"w{i}x"), F.col("id"), F.lit(" ")) for i in range(5)], F.lit("end")).alias("text"))
    said.write.parquet(str(tmp_path / "documents.parquet"))
    said.toDF("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = relating.quote_exact(spark, str(tmp_path))
    assert got.count() == 12_000 and got.where("doc_id = item_id and start_ = 0").count() == 12_000


def test_total_debt_tiers(spark):
    """Columns: two totals, non-current, two current, with leases (total, non-current, current), notes, two convertibles."""
    none = None
    rows = [
        ((3050.0, none, none, none, none, none, none, none, none, none, none), 3050.0, None),
        ((none, none, none, 3387.8, none, 37220.3, 33832.5, 3387.8, none, none, none), 37220.3, "debt_includes_finance_leases"),
        ((29291.0, none, none, 124.0, none, none, 29167.0, none, none, none, none), 29291.0, None),
        ((39973.0, none, 39973.0, 725.0, none, none, none, none, none, none, none), 40698.0, None),
        ((140.0, none, 993.0, none, none, none, none, none, none, none, none), 993.0, None),
        ((none, none, none, none, none, none, 10.0, 5.0, none, none, none), 15.0, "debt_includes_finance_leases"),
        ((none, none, none, none, none, none, none, none, 4.0, 3.0, 2.0), 5.0, "debt_from_instrument_tag"),
        ((-1.0, none, none, none, 7.0, none, none, none, none, none, none), 7.0, "debt_current_portion_only"),
        ((none,) * 11, None, None),
    ]
    df = spark.createDataFrame([r for r, *_ in rows], ", ".join(f"c{i} double" for i in range(11)))
    debt, flag = measures.total_debt(["c0", "c1"], "c2", ["c3", "c4"], "c5", "c6", "c7", "c8", ["c9", "c10"])
    assert [tuple(r) for r in df.select(debt, flag).collect()] == [r[1:] for r in rows]


def screened(spark, years, sector="Tech"):
    """Status of each metric of one company with these years' (revenue, fcf, debt, margin, gross, eps, shares)."""
    from grainledger.operators import screen

    rows = [("A", sector, 2000 + i, float(r), f, d, m, g, 0.1, 0.1, e, s, [], False) for i, (r, f, d, m, g, e, s) in enumerate(years)]
    kind = "ticker string, sector string, fiscal_year int, revenue double, free_cash_flow double, total_debt double, operating_margin double, gross_margin double, roic double, roe double, eps double, shares double, flags array<string>, split boolean"
    return {r["metric"]: r for r in screen.scores(screen.raw_metrics(spark.createDataFrame(rows, kind))).collect()}


def test_screen_metrics_and_states(spark):
    got = screened(spark, [(100, 10.0, 50.0, 0.1, 0.40, 1.0, 100.0), (121, 10.0, 50.0, 0.1, 0.396, 2.0, 100.9)])
    assert got["revenue_growth"]["value"] == pytest.approx(0.21) and got["revenue_growth"]["status"] == "pass"
    assert got["gross_margin"]["value"] == 0.396 and got["gross_margin"]["status"] == "pass"
    assert got["debt_to_fcf"]["value"] == 5.0 and got["debt_to_fcf"]["status"] == "pass" and got["dilution"]["status"] == "pass"
    got = screened(spark, [(100, 10.0, 51.0, 0.1, 0.40, 2.0, 100.0), (121, 10.0, 51.0, 0.1, 0.39, 1.0, 101.5)])
    assert {m: got[m]["status"] for m in ("revenue_growth", "gross_margin", "debt_to_fcf", "dilution")} == dict.fromkeys(("revenue_growth", "gross_margin", "debt_to_fcf", "dilution"), "fail")
    got = screened(spark, [(100, -1.0, 5.0, None, None, 1.0, 100.0)])
    assert got["debt_to_fcf"]["value"] is None and got["debt_to_fcf"]["status"] == "fail"
    assert got["operating_margin"]["status"] == got["gross_margin"]["status"] == got["revenue_growth"]["status"] == "unavailable"
    assert got["operating_margin"]["overall_pass"] is False
    assert {m for m, r in screened(spark, [(100, 1.0, 1.0, 0.1, 0.4, 1.0, 100.0)], "Financials").items() if r["status"] == "not_applicable"} == {"gross_margin", "fcf_margin", "debt_to_fcf"}


def test_overall_score_and_counterfactuals(spark):
    kind = "k int, business double, moat double, strength double, management double, valuation double, risk double, severity string"
    df = spark.createDataFrame([(1, 80.0, 80.0, 80.0, 80.0, 80.0, 20.0, "high"), (2, 40.0, 40.0, 40.0, 40.0, 40.0, 90.0, "low"), (3, 60.0, 60.0, 60.0, 60.0, 60.0, 50.0, "low")], kind)
    got = {(r["k"], r["scenario"]): (round(r["score"], 6), r["status"]) for r in evaluation.counterfactuals(df, "k").collect()}
    assert len(got) == 45 and got[1, "as_is"] == (80.0, "watch") and got[1, "bear_cap_off"] == (80.0, "investigate")
    assert got[2, "as_is"] == (38.5, "reject") and got[2, "bear_left_out"] == (40.0, "reject") and got[1, "bear_gone"] == (80.0, "investigate")
    assert got[1, "quality_nothing"][0] == 36.0 and got[1, "bear_nothing"][0] == 76.0 and got[1, "valuation_midpoint"][0] == 68.0 and got[1, "quality_median"][0] == 69.0


def test_value_class_needs_strict_order(spark):
    from grainledger.operators import valuation

    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 3.0), (1.0, 3.0, 3.0)], "a double, b double, c double")
    cls, reason = valuation.value_class(F.col("a"), F.col("b"), F.col("c"), F.lit(2.0), F.lit(3), F.lit(True))
    assert [tuple(r) for r in df.select(cls, reason).collect()] == [("fair", None), ("abstain", "scenarios out of order"), ("abstain", "scenarios out of order")]


def test_prices_and_partners_that_are_missing(spark):
    """A period without a price on its day takes the last one before; a company on one side only stays."""
    from grainledger.operators import upsert, valuation

    panel = spark.createDataFrame([("a", 2000, "2000-12-31", 2.0), ("a", 2001, "2001-12-31", 4.0), ("b", 2000, "2000-12-31", 1.0)], "ticker string, fiscal_year int, d string, eps double").withColumn("period_end_date", F.to_date("d"))
    prices = spark.createDataFrame([("a", "2000-12-30", 10.0), ("a", "2001-12-31", 40.0), ("b", "2001-01-01", 9.0)], "ticker string, d string, close double").withColumn("date", F.to_date("d"))
    assert [(r["ticker"], r["pe_low"], r["pe_high"]) for r in valuation.past_multiples(panel, prices).collect()] == [("a", 5.0, 10.0)]
    one = lambda *rows: spark.createDataFrame(rows, "ticker string, name string, sector string, tags string")
    got = {r["ticker"]: (r["name"], r["tags"]) for r in upsert.merged_universe(one(("x", "X", None, "c"), ("y", None, None, "c")), one(("y", "Y", None, "s"), ("z", "Z", None, "s"))).collect()}
    assert got == {"x": ("X", "c"), "y": ("Y", "c,s"), "z": ("Z", "s")}
