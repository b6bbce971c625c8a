"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import pytest

from spindrift import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p)[:-8] for p in glob.glob(f"{DIR}/*.parquet")]


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(cols).collect())
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(str([plain(x) for x in r]) for r in rel.project(", ".join(cols)).fetchall())
    assert got == want
