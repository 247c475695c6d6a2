"""Every query with SQL gives what DuckDB gives, over the smallest test tables."""

import os

import duckdb
import pytest

from fabula.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.oracle_sql():
        found = con.execute(queries.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        place = [columns.index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())
