"""What is hidden can't be had from what is shown."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainledger.operators import disclosure


@pytest.mark.parametrize("seed", range(3))
def test_hidden_cells_cannot_be_computed(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdefgh"), rng.choice("xyz"), rng.choice("pq"), rng.choice("mn")) for _ in range(60 + 60 * seed)]
    families = {}  # name: (cells as sets of rows, totals)
    for s in "abcdefgh":
        for name, at in (("quality", 2), ("toxic", 3)):
            families[f"{name} {s}"] = ({v: {i for i, r in enumerate(rows) if r[0] == s and r[at] == v} for v in "pqmn" if any(r[0] == s and r[at] == v for r in rows)}, [f"source {s}"])
    for s in "ab":  # two sources meet in a total
        families[f"both {s}"] = ({s: {i for i, r in enumerate(rows) if r[0] == s}}, [f"source {s}", "ab"])
    counts = spark.createDataFrame([(f, c, len(x)) for f, (cells, _) in families.items() for c, x in cells.items()], "family string, cell string, n long")
    members = spark.createDataFrame([(f, t) for f, (_, totals) in families.items() for t in totals], "family string, total string")
    cells, totals = disclosure.disclosed(counts, members)
    cells, totals = cells.collect(), totals.collect()
    component = {r["family"]: r["component"] for r in cells}
    assert component["quality a"] == component["toxic b"] and component["quality c"] != component["quality d"]
    # equations over the unknown counts of (source, language, quality, toxic): all that is shown
    groups = [(s, v, q, t) for s in "abcdefgh" for v in "xyz" for q in "pq" for t in "mn"]
    index = {g: k for k, g in enumerate(groups)}
    vector = lambda ids: np.bincount([index[rows[i]] for i in ids], minlength=len(groups)) > 0
    known = [vector(families[r["family"]][0][r["cell"]]) for r in cells if r["shown"] is not None]
    known += [vector({i for f, (c, ts) in families.items() if r["total"] in ts for x in c.values() for i in x}) for r in totals if r["shown"] is not None and r["total"] != "ab"]
    known = np.array(known, float).reshape(-1, len(groups))
    rank = np.linalg.matrix_rank(known) if len(known) else 0
    for r in cells:
        if r["shown"] is None:
            assert r["mark"] in (disclosure.SMALL, disclosure.WITHHELD) and (r["mark"] == disclosure.SMALL) == (r["n"] < disclosure.LEAST)
            assert np.linalg.matrix_rank(np.vstack([known, vector(families[r["family"]][0][r["cell"]])])) == rank + 1
        else:
            assert r["n"] >= disclosure.LEAST and r["mark"] is None


def test_long_chain_is_one_component(spark):
    members = spark.createDataFrame([(f"f{i:03}", f"t{i + d}") for i in range(60) for d in (0, 1)] + [("alone", None), ("other", "t99")], "family string, total string")
    got = {r["family"]: r["component"] for r in disclosure.linked_families(members).collect()}
    assert {got[f"f{i:03}"] for i in range(60)} == {"f000"} and got["alone"] == "alone" and got["other"] == "other"
    assert disclosure.linked_families(members.limit(0)).count() == 0


@pytest.mark.parametrize(("numerator", "denominator", "hidden", "want"), [
    (10, 20, False, ("10", "20", 0.5)), (4, 20, False, (disclosure.SMALL, "20", None)), (16, 20, False, (disclosure.SMALL, "20", None)), (3, 4, False, (disclosure.SMALL, disclosure.SMALL, None)),
    (10, 20, True, (disclosure.WITHHELD, disclosure.WITHHELD, None)), (4, 20, True, (disclosure.SMALL, disclosure.WITHHELD, None)), (None, None, False, (None, None, None)),
])
def test_shares(spark, numerator, denominator, hidden, want):
    df = spark.createDataFrame([(numerator, denominator, hidden)], "a long, b long, h boolean")
    got = df.select(*[c.alias(k) for k, c in disclosure.public_share(F.col("a"), F.col("b"), F.try_divide("a", "b"), F.col("h")).items()]).first()
    assert tuple(got) == want


def test_associations(spark):
    df = spark.createDataFrame([(20, 30, False), (4, 30, False), (27, 30, False), (20, None, False), (20, 30, True)], "d long, c long, h boolean")
    got = df.select(*[c.alias(k) for k, c in disclosure.public_association(F.col("d"), F.col("c"), F.lit(0.5), F.col("h")).items()]).collect()
    assert [tuple(r) for r in got] == [("20", 0.5), (disclosure.SMALL, None), (disclosure.WITHHELD, None), ("20", 0.5), (disclosure.WITHHELD, None)]
