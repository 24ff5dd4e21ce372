"""Queries of the subpackage that SQL can express equal DuckDB."""

import os

import duckdb
import pytest

from inkgrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
