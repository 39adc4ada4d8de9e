"""All registered queries at the smallest scale, against their SQL oracles where they have one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

#: Searches that may find nothing in a hundred documents.
MAY_BE_EMPTY = {"p8_found", "p8_passages", "p9_found"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v) if v else "0"
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    if name not in ORACLES:
        rows = df.count()
        assert len(set(df.columns)) == len(df.columns) and (rows > 0 or name in MAY_BE_EMPTY)
        return
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    res = con.execute(ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
