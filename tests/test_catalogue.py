"""Every catalogue query against its SQL in DuckDB, over the smallest test tables."""

import os

import duckdb
import pytest

from streamloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert got == want


def test_every_table_is_there(sf):
    assert all(os.path.exists(f"{sf}/{t}.parquet") for t in TABLES)
