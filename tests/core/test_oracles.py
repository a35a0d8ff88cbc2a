"""Every query of the engine that has SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from galewise.queries import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.all_oracles()))
def test_same_rows(spark, duck, name):
    got = catalog.all_queries()[name](spark, SF)
    want = duck.sql(catalog.all_oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.all_queries()) - set(catalog.all_oracles())))
def test_runs(spark, name):
    assert catalog.all_queries()[name](spark, SF).count() > 0
