"""The queries that have SQL give what DuckDB gives, over the smallest test tables."""

import os

import duckdb
import pytest

from fabula.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert rows and sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in df.columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())
