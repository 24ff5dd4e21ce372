"""Every query with SQL equals DuckDB over the same tables; the others return rows."""

import math
import os

import duckdb
import pytest

from inkgrid import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _rows(rows, order):
    tidy = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert _rows(df.collect(), [df.columns.index(c) for c in columns]) == _rows(want.fetchall(), [want.columns.index(c) for c in columns])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_return_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


NATIVE = ("fused_fields", "layout_cells", "page_geometry", "gap_audit", "best_templates", "quarantine_gate")


@pytest.mark.parametrize("name", NATIVE)
def test_plans_run_no_python(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
