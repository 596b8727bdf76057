"""Every query with SQL text against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fluxgrid.plans import registry


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("null" if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, duck, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-9 * max(1, abs(u)), (x, y)
