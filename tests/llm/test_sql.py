"""Queries of the corpus operators with SQL against DuckDB, on the smallest supplied tables."""

import os

import duckdb
import pytest

from grainledger.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_substrings", "op7_vector_dedup", "op9_minhash"])
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    got, want = QUERIES[name](spark, DIR), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall())
