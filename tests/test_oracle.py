"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from grainledger.plans import auditing, benchmarks, disclosing, evidencing, filing, relating, screening, storing, valuing

DIR = "/root/testdata/sf0.001"
SQL = screening.SQL | valuing.SQL | relating.SQL | evidencing.SQL | filing.SQL | auditing.SQL | disclosing.SQL | storing.SQL | benchmarks.SQL
QUERIES = screening.QUERIES | valuing.QUERIES | relating.QUERIES | evidencing.QUERIES | filing.QUERIES | auditing.QUERIES | disclosing.QUERIES | storing.QUERIES | benchmarks.QUERIES


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).columns
