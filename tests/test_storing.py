"""Stages, schema versions, merges and batches."""

import random

import pytest
from pyspark.sql import functions as F

from grainledger.operators import lifecycle, upsert
from grainledger.sources import versions
from grainledger.streaming import incremental


def test_a_failed_stage_leaves_the_old_rows(spark, tmp_path):
    root = f"file://{tmp_path}"
    kind = "k int, v string"
    read = lambda name: sorted((r["k"], r["v"], r["run"]) for r in versions.committed(spark, root, name, kind).collect())
    df = lambda *rows: spark.createDataFrame(rows, kind)
    assert read("a") == []
    versions.commit_stage(root, "one", {"a": df((1, "x")), "b": df((2, "y"))})
    broken = df((3, "z")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        versions.commit_stage(root, "two", {"a": df((9, "w")), "b": broken})
    assert read("a") == [(1, "x", "one")] and read("b") == [(2, "y", "one")]
    versions.commit_stage(root, "two", {"a": df((9, "w")), "b": df()})
    versions.commit_stage(root, "one", {"a": df((1, "again"))})  # replaced as a whole: b isn't part of it any more
    assert read("a") == [(1, "again", "one"), (9, "w", "two")] and read("b") == []


def test_schema_steps(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    steps = [
        versions.Step(1, rename={"old": "name"}, add={"unit": ("string", "'USD'")}), versions.Step(2, recode={"status": {"done": "complete", "err": "failed"}}),
        versions.Step(3, retire="status = 'failed'", unique=(("k",), ("at",)), add={"n": ("long", "length(name)")}),
    ]
    spark.createDataFrame([(1, "a", "done", 5), (2, "bb", "err", 1), (4, "old", "done", 1)], "k int, old string, status string, at int").write.parquet(f"{root}/schema_version=0")
    spark.createDataFrame([(1, "later", "done", "EUR", 9), (3, None, None, None, 2)], "k int, name string, status string, unit string, at int").write.parquet(f"{root}/schema_version=1")
    spark.createDataFrame([(4, "new", "complete", "GBP", 7, 3)], "k int, name string, status string, unit string, at int, n long").write.parquet(f"{root}/schema_version=3")
    want = [(1, "later", "complete", "EUR", 9, 5), (3, None, None, None, 2, None), (4, "new", "complete", "GBP", 7, 3)]
    read = lambda: sorted(tuple(r[c] for c in ("k", "name", "status", "unit", "at", "n")) for r in versions.migrated(spark, root, steps).collect())
    assert read() == want
    assert versions.migrate(spark, root, steps) == [0, 1] and read() == want
    assert versions.migrate(spark, root, steps) == [] and read() == want
    df = spark.createDataFrame([(1, "a", "done", 5), (1, "b", "err", 6), (1, "c", "done", 4)], "k int, old string, status string, at int")
    once = df
    for s in steps:
        once = s.apply(once)
        assert sorted(map(str, s.apply(once).collect())) == sorted(map(str, once.collect()))
    with pytest.raises(ValueError, match="no version"):
        versions.migrated(spark, f"{root}/none", steps)


def test_cover():
    for n in range(1, 700):
        got = versions.cover(n)
        assert [e for a, b in got for e in range(a, b + 1)] == list(range(n))
        assert len(got) <= (versions.FAN - 1) * 4


def test_merges_follow_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FAN", 3)
    path, rng, want = f"file://{tmp_path}/m", random.Random(4), {}
    for epoch in range(11):
        rows = [(rng.choice([None, *range(12)]), rng.randrange(20), f"{epoch}.{i}") for i in range(8)]
        batch = spark.createDataFrame(rows, "k int, at int, v string")
        for k, at, v in rows:
            if k not in want or (at, epoch) >= want[k][:2]:
                want[k] = (at, epoch, v) if k not in want or (at, epoch) > want[k][:2] else want[k]
        for _ in range(2 if epoch in (2, 5) else 1):  # run again after a failure
            versions.merge_batch(batch, epoch, path, ["k"], ["at"])
        got = {r["k"]: r["at"] for r in versions.merged(spark, path, ["k"], ["at"]).collect()}
        assert got == {k: x[0] for k, x in want.items()}
    names = sorted(p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith("."))
    assert len(names) <= 2 * len(versions.cover(11)) + 3


def test_restarted_stream_gives_the_same_table(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/out"
    kind = "k int, at int, v string"
    rows = [[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (3, 1, "d")], [(1, 2, "late"), (2, 5, "e")]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).parquet(str(source))
        incremental.merge_latest(stream, path, f"{tmp_path}/check", ["k"], "at").awaitTermination()
    got = sorted(tuple(r) for r in versions.merged(spark, path, ["k"], ["at"]).select("k", "at", "v").collect())
    assert got == [(1, 3, "c"), (2, 5, "e"), (3, 1, "d")]


def test_upserts_of_some_columns(spark):
    kind = "k int, name string, v int, at int"
    old = spark.createDataFrame([(1, "a", 1, 1), (2, None, 2, 1), (None, "n", 3, 1)], kind)
    new = spark.createDataFrame([(1, "x", None, 5), (1, "y", 9, 4), (2, "z", 7, 2), (None, "m", 8, 2), (4, "new", 4, 2)], kind)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(upsert.retaining_upsert(old, new, ["k"], ["name"], "at")) == sorted([(1, "a", None, 5), (2, None, 7, 2), (None, "n", 8, 2), (4, "new", 4, 2)], key=str)
    assert rows(upsert.partial_upsert(old, new, ["k"], ["v"], "at")) == sorted([(1, "a", None, 1), (2, None, 7, 1), (None, "n", 8, 1)], key=str)


def test_batches(spark):
    none = spark.createDataFrame([], lifecycle.ATTEMPT)
    request = lambda batch, *tickers: spark.createDataFrame([("r", t, batch, "m", f"{t}hash0123456789abcdef") for t in tickers], "run_id string, ticker string, batch_id string, model_id string, prompt_sha256 string")
    first = lifecycle.submitted(request("b1", "A", "B", "C", "D", "E"), none)
    assert lifecycle.submitted(request("b1", "A", "B"), first).count() == 5
    ids = {r["ticker"]: r["custom_id"] for r in first.collect()}
    assert len(set(ids.values())) == 5 and all(len(i) <= 64 for i in ids.values())
    results = spark.createDataFrame([(ids["A"], "end_turn", 2.0), (ids["B"], "refusal", 3.0), (ids["C"], "api_error", None), (ids["D"], "max_tokens", 1.0), ("other", "end_turn", 1.0)], "custom_id string, stop_reason string, cost double")
    issues = spark.createDataFrame([(ids["D"], "truncated"), (ids["D"], "truncated"), (ids["B"], "uncited")], "custom_id string, code string")
    state = lambda df: sorted((r["ticker"], r["outcome"], r["failure"], r["cost"]) for r in df.collect())
    want = [("A", "persisted", None, 2.0), ("B", "refusal", None, 0.0), ("C", "api_error", None, 0.0), ("D", "validation_failed", "truncated", 1.0), ("E", "pending", None, 0.0)]
    done = lifecycle.retrieved(first, "b1", results, issues)
    assert state(done) == want and state(lifecycle.retrieved(done, "b1", results, issues.limit(0))) == want
    assert state(lifecycle.retrieved(first, "b2", results, issues)) == [(t, "pending", None, 0.0) for t in "ABCDE"]
    again = lifecycle.submitted(request("b2", "D"), done)
    assert sorted(r["attempt"] for r in again.where("ticker = 'D'").collect()) == [1, 2] and again.select("custom_id").distinct().count() == 6
    assert lifecycle.summary(done).where("outcome = 'pending'").first()["n"] == 1
