"""Each query against its SQL, run by DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from quire.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_like_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {d[0]: str(d[1]) for d in found.description} == {c: kinds[t] for c, t in df.dtypes}
    assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert got


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
