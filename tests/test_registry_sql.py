"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from verispan.plans import registry


def rows_of(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    want = duck.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
