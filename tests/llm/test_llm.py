"""The corpus operators against brute force, on tables with every odd case, and on the smallest supplied tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from grainledger.llm import ann, brown_lm, language_id, minhash, mixing, packing, quality, substrings, token_files, vector_dedup
from grainledger.llm.common import remainder
from grainledger.llm.token_ids import WordEncoder, tokenizer_path

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
KIND = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int, own_text string, word string"


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns whose names clash with inner ones."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = said(30), said(120)
    texts = [None, "", "   \n", "one", "One", said(3), base, base, base + " " + said(4), base.upper(), f"{said(50)} {passage} {said(20)}", f"{said(9)}\n{passage}\t{said(60)}", said(6000), "é\xa0ü " * 40, "!!! ??? 123", said(12), said(13)]
    texts += [f"{base} {said(i)}" for i in range(8)]
    rows = [(i if i != 9 else None, t, [None, "en", "de"][i % 3], [None, "a", "b", "hot"][min(i % 7, 3)], len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)]
    rows += [rows[6], rows[10]]
    return spark.createDataFrame(rows, KIND).repartition(3), rows


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


# brute force


def repeats(rows, window=13):
    last = 1 << 62
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (last if i is None else i):
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(a for a, b in zip(w, gone) if not b).encode()).hexdigest()))
    return sorted(out, key=str)


def near(rows, percent=75):
    sets = []
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# the operators


def test_substrings(odd, documents, empty):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substrings.remove_repeats(odd[0]), *columns) == repeats([r[:2] for r in odd[1]])
    assert got(substrings.remove_repeats(documents[0]), *columns) == repeats(documents[1])
    assert substrings.remove_repeats(empty).count() == 0
    with_texts = substrings.remove_repeats(odd[0], keep=["text", "shard", "own_text", "word"], texts=True).collect()
    for r in with_texts:
        assert hashlib.sha256(" ".join(words(r["kept"])).encode()).hexdigest() == r["kept_sha256"]


def test_minhash(odd, documents, empty):
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert got(minhash.near_duplicates(odd[0]), *columns) == near([r[:2] for r in odd[1]])
    assert got(minhash.near_duplicates(documents[0]), *columns) == near(documents[1])
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 2000):
        for t in (128, 512):
            assert (minhash.sketch(rng.integers(0, 1 << 63, n).astype(np.uint64), t) > 0).all()
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:750], rng.integers(0, 1 << 63, 250).astype(np.uint64)])
    same = np.mean(minhash.sketch(a, 2048) == minhash.sketch(b, 2048))
    assert abs(same - 0.6) < 0.05


def test_encoder_equals_library():
    texts = ["", "  a\n\n b  ", "x\xa0y <|endoftext|> z", "don't  stop\t\t now 's\n", "ΑΣ ΑΣ.", "a\x1c b", "a b.\nc d", "it's!!'s a,'t", " a b ", "Über größe, é."]
    for name, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = WordEncoder(tokenizer_path(name), space, remember=4)
        for t in texts:
            assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@functools.cache
def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, pieces, tokens=2048):
    want = Counter()
    for i, t in rows:
        for at, x in enumerate(ids_of("byte_bpe_50k.json", t)):
            want[(i, at)] += 1
    assert sum(p["length"] for p in pieces) == sum(want.values())
    for p in pieces:
        for at in range(p["start"], p["start"] + p["length"]):
            want[(p["doc_id"], at)] -= 1
    assert not any(want.values())
    of = {}
    for p in pieces:
        of.setdefault(p["sequence_id"], []).append(p)
    for own in of.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= tokens
    return of


def test_packing(odd, documents, empty):
    text = dict(documents[1])
    pieces = packing.pack(documents[0]).collect()
    of = check_packing(documents[1], pieces)
    for p in pieces[:200]:
        ids = ids_of("byte_bpe_50k.json", text[p["doc_id"]])
        assert crc(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] and p["doc_tokens"] == len(ids)
    sizes = [sum(p["length"] for p in own) for own in of.values()]
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 0.02 * sum(sizes)
    check_packing([r[:2] for r in odd[1]], packing.pack(odd[0]).collect())
    assert packing.pack(empty).count() == 0


def test_packing_keeps_all_limits(spark):
    rows = [(i, "word " * (i % 9 * 5 + 1), i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    pieces = packing.pack(df, tokens=64, segments=3, loss=40, loss_from="prompt").collect()
    for own in check_packing([r[:2] for r in rows], pieces, 64).values():
        assert len(own) <= 3 and sum(p["loss_tokens"] for p in own) <= 40


def test_token_files(spark, odd, documents, empty, tmp_path):
    for n, (df, rows) in enumerate(((documents[0], documents[1]), (odd[0], [r[:2] for r in odd[1]]))):
        folder = f"file://{tmp_path}/{n}"
        back = token_files.read_ids(spark, folder, token_files.write_ids(df, folder, shard_bytes=40_000)).collect()
        at, want = 0, []
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = ids_of("word_bpe_49k.json", t)
            want.append((i, at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted(map(tuple, back), key=str) == sorted(want, key=str)
    assert token_files.read_ids(spark, f"file://{tmp_path}/e", token_files.write_ids(empty, f"file://{tmp_path}/e")).count() == 0


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    assert mixing.targets({"b": 0, None: 10}) == {"b": 0, None: 15.0}
    for quotas in ([5, 0, 9], [1, 1, 1]):
        parts = mixing.split(np.array(quotas), 7, 1)
        assert parts.sum(0).tolist() == quotas and (parts >= 0).all() and parts.sum(1).max() - parts.sum(1).min() <= 2


def test_mixing(odd, documents, empty):
    for df in (odd[0], documents[0]):
        one, two = (got(mixing.mix(df), "doc_id", "source", "size", "source_size", "target", "taken") for _ in range(2))
        assert one == two and len(one) == df.count()
        total = Counter()
        for _, s, size, _, _, taken in one:
            assert 0 <= taken <= 2 * size
            total[s] += taken
        for _, s, _, _, target, _ in one:
            assert abs(total[s] - target) <= 1
    assert mixing.mix(empty).count() == 0
    texts = mixing.mixed(documents[0]).collect()
    assert sum(len(words(r["text"])) for r in texts) == sum(r[5] for r in one)


def test_brown_scores(spark, odd, documents, empty):
    for df, rows in ((documents[0], documents[1]), (odd[0], [r[:2] for r in odd[1]])):
        flagged = df.select("*", (remainder("doc_id", 7) == 2).alias("held_out")).na.fill(False, ["held_out"])
        out = brown_lm.class_model_scores(flagged).collect()
        low = [(i, words((t or "").translate(LOWER)), i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
        c, ends = Counter(w for _, ws, h in low if not h for w in ws), sum(not h for *_, h in low)
        n, v = sum(c.values()) + ends, len(c) + 1
        want = sorted((str(i), h, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 6)) for i, w, h in low)
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    base = sum(r["base_score"] for r in out if r["held_out"])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out) and base < 0
    flagged = empty.selectExpr("*", "false as held_out")
    assert brown_lm.class_model_scores(flagged).count() == 0


def test_brown_model_is_better_than_counts(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet").select("*", (remainder("doc_id", 7) == 2).alias("held_out"))
    out = brown_lm.class_model_scores(df).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_id(spark, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in language_id.op2_language_id(spark, "/root/testdata/sf0.01").collect()}
    held = [(r["lang"], out[r["doc_id"]]["lang_pred"]) for r in df.select("doc_id", "lang").collect() if out[r["doc_id"]]["held_out"]]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97
    model = language_id.learn(language_id.learning_rows(odd[0]))
    got_ = language_id.predict(odd[0], *model, keep=["text", "kept"]).collect()
    assert len(got_) == len(odd[1]) and {r["lang_pred"] for r in got_ if not any(c.isalpha() for c in r["text"] or "")} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got_)
    none = language_id.learn(language_id.learning_rows(empty))
    assert language_id.predict(empty, *none).count() == 0 and {r["lang_pred"] for r in language_id.predict(odd[0], *none).collect()} == {"und"}


def test_quality(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r["doc_id"]: r for r in quality.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    held = [(r["quality"], out[r["doc_id"]]["predicted"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (6, 1)], "doc_id long, quality int")
    for own in (marks, marks.limit(0), marks.where("quality = 1")):
        got_ = quality.quality_scores(odd[0], quality.learn(odd[0], own)).collect()
        assert len(got_) == len(odd[1]) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got_)
    assert quality.quality_scores(empty, quality.learn(empty, marks)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, shard int, vec string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[100:160] = x[100] + 0.1 * rng.normal(size=(60, 16))
    x[200:220] = x[200]
    rows = [(i, [float(c) for c in v], None if i % 2 else 1, 1, "x") for i, v in enumerate(x)]
    rows += [(700, None, 1, 1, "x"), (701, [0.0] * 16, 1, 1, "x"), (702, [float("nan")] + [1.0] * 15, 1, 1, "x"), (703, [None] + [1.0] * 15, 1, 1, "x"), (704, [float("inf")] * 16, 1, 1, "x"), (705, [1.0, 2.0], 1, 1, "x"), (706, [], 1, 1, "x"), (None, rows[0][1], 1, 1, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    kept = {r["vec_id"]: np.array(r["embedding"], float) for r in df.where("vec_id < 700").collect()}
    m = np.stack([kept[i] for i in range(700)])
    return df, m / np.sqrt((m * m).sum(1, keepdims=True))


def test_vector_dedup(vectors, spark):
    df, u = vectors
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    label = np.arange(700)
    while True:
        new = np.minimum(label, np.where(s, label[None, :], 700).min(1))
        if (new == label).all():
            break
        label = new
    out = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert len(out) == 708
    found, true = sum(out[i]["n_links"] for i in range(700)), s.sum()
    assert 0.97 * true <= found <= true and all(out[i]["n_links"] <= s[i].sum() for i in range(700))
    assert np.mean([out[i]["component_id"] == label[i] for i in range(700)]) > 0.99
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in range(700, 707))
    assert out[None]["component_id"] is None and out[None]["kept"]
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vector_dedup_audit(spark, monkeypatch):
    """A search that misses all pairs is widened, though few vectors have one, and an error if it stays so."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x[:7] = x[700:707] + 0.01 * rng.normal(size=(7, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS.split(", label")[0].replace("float", "double"))
    real, widths = vector_dedup._links, []

    def poor(base, count, least, overlap, beam, from_=2):
        widths.append(overlap)
        return real(base, count, least, overlap, beam).where("true" if len(widths) >= from_ else "false")

    monkeypatch.setattr(vector_dedup, "_links", poor)
    out = {r["vec_id"]: r["component_id"] for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert widths == [3, 6] and all(out[700 + i] == i for i in range(7))
    monkeypatch.setattr(vector_dedup, "_links", lambda *a: poor(*a, from_=99))
    with pytest.raises(RuntimeError, match="audited"):
        vector_dedup.near_duplicate_vectors(df)


def test_vector_dedup_recall_by_vector(spark):
    """A large group that was found doesn't outweigh the pairs that weren't."""
    true = spark.createDataFrame([(i, 39) for i in range(40)] + [(100 + i, 1) for i in range(40)], "own long, n long")
    found = spark.createDataFrame([(i, i, 20) for i in range(40)] + [(i, i, 19) for i in range(40)] + [(0, 1, 0)], "a long, b long, n long")
    assert vector_dedup._recall(true, found) == 0.5
    assert vector_dedup._recall(true.limit(0), found) == 1.0


def test_vector_dedup_rows_follow_vectors(spark):
    """A dense group of different vectors gives a few rows a vector, not its pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + 0.02 * rng.normal(size=(900, 16))
    base = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, vec array<double>, copies long")
    found = vector_dedup._links(base, 900, 0.9, 3, 48).collect()
    assert len(found) <= 3 * 900 and {r["n"] for r in found if r["a"] == r["b"]} == {899}


def test_cells_of_two_levels(spark, monkeypatch):
    """More cells than one level has: nearly all vectors get their nearest one, and both operators still find their rows."""
    from grainledger.llm import vectors as v

    monkeypatch.setattr(v, "FLAT", 8)
    monkeypatch.setattr(v, "FIT", 300)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 2000)] + 0.15 * rng.normal(size=(2000, 12))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, vec array<double>")
    cells, _ = v.fit_cells(df, 2000, 60, 5)
    assert not cells.flat and 40 <= len(cells.all) <= 90
    u = v.unit(x).astype(np.float32)
    assert np.mean(cells.nearest(u, 1)[:, 0] == v.nearest(u, cells.all, 1)[:, 0]) > 0.95
    s = v.unit(x) @ v.unit(x).T
    np.fill_diagonal(s, -2)
    rows = df.withColumnRenamed("vec", "embedding")
    hits, found = 0, {}
    for r in ann.nearest_neighbours(rows, rows.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(found) == 100 and np.mean([len(own & set(np.argsort(-s[q])[:5].tolist())) / 5 for q, own in found.items()]) > 0.9
    monkeypatch.setattr(vector_dedup, "SHARD", 60)
    out = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicate_vectors(rows).collect()}
    true = (s >= 0.9).sum(1)
    assert all(out[i] <= true[i] for i in out) and sum(out.values()) >= 0.95 * true.sum()


def test_neighbours_of_queries_of_other_lengths(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0, 0.5]) for i in range(20)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 1.0, 0.5]), (100, [1.0]), (101, [2.0])], "vec_id long, embedding array<double>")
    assert {r["query_id"] for r in ann.nearest_neighbours(rows, queries).collect()} == {0}


def test_neighbours_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0, 0.0] if i % 2 else [0.0, 1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(rows, rows.where("vec_id in (1, 7)")).collect())
    assert [v for q, _, v in out if q == 1] == [3, 5, 7, 9, 11] and [v for q, _, v in out if q == 7] == [1, 3, 5, 9, 11]
    assert ann.nearest_neighbours(rows.where("vec_id < 0"), rows).count() == 0


def test_nearest_neighbours(vectors, spark):
    df, u = vectors
    out = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 10 = 0")).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(out) == list(range(0, 700, 10))
    hits = 0
    for q, found in out.items():
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(700), -s.round(12)))[:5].tolist()
        hits += len(set(best) & {v for v, _ in found.values()})
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(s[v] - score) < 1e-12 for v, score in found.values())
    assert hits >= 0.9 * 5 * len(out)
    few = df.where("vec_id < 3")
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(few, few).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0 and ann.nearest_neighbours(df, df.limit(0)).count() == 0


def test_neighbours_of_outliers(spark, monkeypatch):
    """Outliers that are alone in their lists beside a hot cluster, where the audit is content with one list."""
    monkeypatch.setattr(ann, "SHARE", 0.0)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(640, 16))
    x[40:] = x[40] + 0.05 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ranks = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id < 60")).collect():
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert sorted(ranks) == list(range(60)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in ranks.values())


def test_pipeline(spark, tmp_path):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    docs = spark.createDataFrame(rows)
    (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = corpus_pipeline.STAGES
    docs = first(spark, docs, DIR)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(kept) == len(rows)
    docs = second(spark, docs, DIR)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _, _, k in near(kept) if k)
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = third(spark, docs, DIR)
    assert docs.columns == list(rows[0].asDict())
    assert sorted((r["doc_id"], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in docs.collect()) == sorted((i, h) for i, _, _, h in repeats(before))
    docs = fourth(spark, docs, DIR)
    mixed = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert fifth(spark, docs, DIR).agg({"length": "sum"}).first()[0] == sum(len(ids_of("byte_bpe_50k.json", t)) for _, t in mixed)
    assert corpus_pipeline.run(spark, DIR).count() > 0


def shard_of(rows):
    import pyarrow as pa

    return substrings._Shard(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}), 13, 5)


def removed(rows, passages):
    """What a shard removes of its documents, given passages of other ones."""
    s = shard_of(rows)
    gone = substrings._gone(s, shard_of(passages))
    return {i: int(gone[a:b].sum()) for i, a, b in zip(s.ids, s.first[:-1], s.first[1:])}


def test_automaton_decides(monkeypatch):
    """Without the automaton's occurrences nothing is removed; hashes that all collide change nothing."""
    rng = random.Random(5)
    said = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = said(30)
    texts = [said(20) + passage + said(9), passage + said(5), said(40), said(7) + passage[3:25] + said(8), said(6) + passage[:12] + said(6), passage[:20] + ["w"] + passage[20:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = {i: gone for i, _, gone, _ in repeats(rows)}
    assert sum(want.values()) == 30 + 22 + 20 and removed(rows, rows) == want
    with monkeypatch.context() as m:
        m.setattr(substrings, "_located", lambda shard, passages: np.zeros(len(shard.words), bool))
        assert not any(removed(rows, rows).values())
    with monkeypatch.context() as m:
        m.setattr(substrings, "gram_hashes", lambda words, n, salt=0: np.zeros(max(0, len(words) - n + 1), np.uint64))
        assert removed(rows, rows) == want
    other = [w if n != 6 else "other" for n, w in enumerate(passage[:13])]
    with monkeypatch.context() as m:
        m.setattr(substrings, "word_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
        assert removed([(5, " ".join(passage[:13]))], [(1, " ".join(other))]) == {5: 0}


def test_packing_short_texts(spark):
    """Segments run out before tokens: still no padding and no empty piece."""
    rng = random.Random(9)
    sizes = [1, 2, 3, 4, 5]
    rows = [(i, " ".join("abc"[rng.randrange(3)] for _ in range(rng.choice(sizes) - 1))) for i in range(3000)]
    for part in (rows, [(i, "a b") for i in range(3000)], rows[:2]):
        pieces = packing.pack(spark.createDataFrame(part, "doc_id long, text string").coalesce(1)).collect()
        of = check_packing(part, pieces)
        held = [sum(p["length"] for p in own) for own in of.values()]
        assert all(p["length"] > 0 for p in pieces) and all(len(own) <= 256 for own in of.values())
        assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in held) == 0


CLASHING = ("score", "lang_pred", "kept", "n_words", "shard", "size", "taken", "draw", "place", "block", "sid", "turn", "own_text", "aside_0", "bits", "a`b.c")


def test_stages_on_odd_tables(spark, odd, empty):
    """Every stage on nulls, repeats and clashing names: other columns come out as they went in, by document."""
    for clashing in (False, True):
        docs = odd[0].drop("kept", "shard", "own_text", "word")
        if clashing:
            docs = docs.select("*", *[(docs.doc_id * 100 + i).alias(c) for i, c in enumerate(CLASHING)])
        names = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DIR)
            rows = docs.collect()
            assert rows or name == "language ID"
            if k < 4:
                assert docs.columns == names
                if clashing:
                    assert all(r[c] == (None if r["doc_id"] is None else r["doc_id"] * 100 + i) for r in rows for i, c in enumerate(CLASHING))
                docs = spark.createDataFrame(rows, docs.schema)
            else:
                assert all(r["length"] > 0 for r in rows)
    nothing = empty.select("doc_id", "text", "lang", "source", "n_chars", "kept", "shard")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DIR).count() == 0


def test_stage_language_id_on_odd(spark, odd):
    docs = odd[0]
    got_ = corpus_pipeline.language_id(spark, docs, DIR).collect()
    assert all(any(c.isalpha() for c in r["text"]) for r in got_) and {r["doc_id"] for r in got_} >= {None}


def test_mixing_reruns_with_repeated_ids(spark):
    """Rows of one id and size but other texts are still drawn alike, however they are dealt."""
    rows = [(i % 5 or None, " ".join([w] * 40), "s") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)]
    draw = lambda n: sorted((str(r["doc_id"]), r["text"]) for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect())
    assert draw(1) == draw(7)


def test_mixing_shards_follow_bytes():
    assert [mixing.shards_for(b) for b in (0, 1 << 20, 1 << 30, 8 << 30, 1 << 40)] == [1, 1, 64, 64, 4096]
    blocks = np.array([(s, b, b * 10, 10) for s in range(3) for b in range(500)], np.int64)
    plan = mixing._plan(blocks, {0: 5000, 1: 10_000, 2: 17}, 97, 1)
    taken = Counter()
    for s, _, _, s0, t0, s1, t1 in plan:
        assert (s0 is None) == (t0 == 0) and (s1 is None) == (t1 == 0)
        taken[s] += t0 + t1
    assert taken == {0: 5000, 1: 10_000, 2: 17} and len({p[3] for p in plan} - {None}) == 97


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(spark.createDataFrame([(i, "x", str(i)) for i in range(3)], "doc_id long, text string, lang string"))


def multinomial(rows, texts, buckets, smooth=0.1):
    """Naive Bayes by plain counting: (language, posterior) of each text."""
    langs = sorted({lang for _, lang in rows})

    def found(text):
        out = Counter()
        for h, _ in language_id.grams([text], 3, buckets):
            out.update(h.tolist())
        return out

    counts = {s: sum((found(t) for t, own in rows if own == s), Counter()) for s in langs}
    prior = {s: math.log(sum(own == s for _, own in rows) / len(rows)) for s in langs}
    out = []
    for t in texts:
        total = {s: prior[s] + sum(n * math.log((counts[s][h] + smooth) / (sum(counts[s].values()) + smooth * buckets)) for h, n in found(t).items()) for s in langs}
        best = max(langs, key=lambda s: (total[s], [-ord(c) for c in s]))
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


def test_language_id_equals_counting(spark):
    rows = [("the cat sat on the mat", "en"), ("a dog ran to the house", "en"), ("die katze sitzt im haus", "de"), ("le chat est dans la maison", "fr"), ("\U00010400\U00010401 dog", "en")]
    texts = ["the house", "haus und katze", "la maison", "\U00010428\U00010429 dog", "x y z", "the haus"]
    learned = language_id.learn(spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string"), buckets=1 << 12)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *learned).collect()}
    for i, (lang, share) in enumerate(multinomial(rows, texts, 1 << 12)):
        assert out[i][0] == lang and abs(out[i][1] - share) < 1e-4
    low, high = ([h.tolist() for h, _ in language_id.grams([t], 3)] for t in ("\U00010428\U00010429", "\U00010400\U00010401"))
    assert low == high


def test_brown_score_equals_counting(spark):
    """With fewer words than classes each word is a class of its own: then the score follows from counts alone."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "abcde" for b in "xyz"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 5 + i % 11]) for _ in range(rng.randint(0, 30))), i % 4 == 0) for i in range(60)]
    rows += [(60, "only once", False), (61, "ax never by NEVER once", True), (62, None, True)]
    train = [words((t or "").lower()) for _, t, held in rows if not held]
    c = Counter(w for t in train for w in t)
    tail = lambda w: f"<{zlib.crc32(w.encode()[-2:]) % 24}>"
    states = [*c, *(f"<{i}>" for i in range(24)), "."]
    n = Counter()
    for t in train:
        n.update(zip([".", *t], [*t, "."]))
    once = {f"<{i}>": [w for w in c if c[w] == 1 and tail(w) == f"<{i}>"] for i in range(24)}
    for s, own in once.items():
        for x in [*c, "."]:
            n[x, s] = sum(n[x, w] for w in own)
    for s, own in once.items():
        for x in states:
            n[s, x] = sum(n[w, x] for w in own)
    into, out_of = (Counter() for _ in range(2))
    for (a, b), m in n.items():
        into[b] += m
        out_of[a] += m
    everything = sum(n.values())

    def score(text):
        line = ["."] + [w if w in c else tail(w) for w in text] + ["."]
        total = sum(math.log10((n[a, b] + 20 * (into[b] + 1) / (everything + len(states))) / (out_of[a] + 20)) for a, b in zip(line, line[1:]))
        return total - sum(math.log10(len(once[tail(w)]) + 1) for w in text if w not in c)

    out = {r["doc_id"]: r["score"] for r in brown_lm.class_model_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    for i, t, _ in rows:
        assert abs(out[i] - score(words((t or "").lower()))) < 1e-6


def test_brown_rare_and_equally_frequent_words(spark, monkeypatch):
    """All words equally frequent, more than may be seeds or broadcast: the same base counts, whatever is broadcast."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        rng.shuffle(vocabulary)
        rows.append((i, " ".join(vocabulary), i % 5 == 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    whole = {r["doc_id"]: r for r in brown_lm.class_model_scores(df).collect()}
    monkeypatch.setattr(brown_lm, "SEEDS", 50)
    monkeypatch.setattr(brown_lm, "FREQUENT", 120)
    few = {r["doc_id"]: r for r in brown_lm.class_model_scores(df).collect()}
    for i, r in few.items():
        assert (r["n_tokens"], r["n_known"]) == (401, 401) and abs(r["base_score"] - whole[i]["base_score"]) < 1e-6
        assert abs(r["score"] - whole[i]["score"]) < 0.05 * abs(r["score"])
    counts = df.selectExpr("explode(split(text, ' ')) as w").groupBy("w").count().selectExpr("cast(w as binary) word", "count c")
    assert 40 < counts.where(brown_lm._most_frequent(counts, 50)).count() <= 50


def test_brown_assigns_all_words(spark):
    """Words that aren't seeds get the class of words with the same neighbours."""
    counts = np.zeros((4 + brown_lm.TAILS + 1,) * 2)
    counts[0, 1] = counts[1, 0] = counts[2, 3] = counts[3, 2] = 1000
    of = np.concatenate([[0, 1, 2, 3], 4 + np.arange(brown_lm.TAILS + 1)])
    m = len(of)
    rows = [(b"like0", np.array([1, 1 + m] * 3, np.uint16).tobytes()), (b"like0", np.array([1, 1 + m], np.uint16).tobytes()), (b"like3", np.array([2, 2 + m], np.uint16).tobytes())]
    rows = [(bytearray(w), bytearray(x)) for w, x in rows]
    out = brown_lm._assigned(spark.createDataFrame(rows, "word binary, near binary"), of, counts).collect()
    assert sorted((bytes(r["word"]), r["c"], r["cls"]) for r in out) == [(b"like0", 4, 0), (b"like3", 1, 3)]


def test_minhash_strays(spark, monkeypatch):
    """Documents that share most of a template, in blocks of a few: those linked with others than the centre are found."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(21)
    said = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    template = said(150)
    rows = []
    for i in range(12):  # twelve families, about 0.6 alike
        family = template[:110] + said(40)
        rows += [(3 * i + j, " ".join(family + said(2 * j))) for j in range(3)]
    rows += [(100 + i, " ".join(template[:135] + said(3 * i))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == near(rows)
