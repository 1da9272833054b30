"""Queries of the subpackage with SQL give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from verispan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["p2_records", "p2_layers", "p4_found", "p4_entities", "p7_found", "p8_report"])
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
