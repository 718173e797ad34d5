"""Near duplicates where one id stands for several texts."""

import random

import corpus_pipeline
from grainledger.llm import minhash


def said(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def brute(rows):
    """Rows as nodes; a row of an id and a set that was there is the same document. Gives (id, least id linked, kept) for each."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            same = rows[a][0] == rows[b][0] and sets[a] == sets[b]
            if same or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, least[find(a)] if i is not None else None, i is None or i == least[find(a)]) for a, (i, _) in enumerate(rows)), key=str)


def test_five_rows(spark):
    rng = random.Random(1)
    a, b, c = said(rng), said(rng), said(rng)
    rows = [(3, a, "x", "s", 1), (5, a, "x", "s", 1), (5, b, "x", "s", 1), (9, b, "x", "s", 1), (7, c, "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.minhash_dedup(spark, docs, "").collect())
    assert kept == [(3, a), (5, b), (7, c)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    bases = [said(rng) for _ in range(9)]
    rows = []
    for _ in range(120):
        t = rng.choice(bases)
        if rng.random() < 0.5:
            w = t.split()
            w[rng.randrange(60)] = said(rng, 1)
            t = " ".join(w)
        rows.append((rng.choice([None, *range(-4, 40)]), rng.choice([t, t.upper(), t, None, "  "])))
    rows += rows[:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    # every text that has words is still there, or one near it, and of a group one document
    out = corpus_pipeline.minhash_dedup(spark, docs.selectExpr("*", "'a' AS text2"), "")
    assert out.count() == sum(k for *_, k in brute(rows)) and out.columns == ["doc_id", "text", "text2"]
