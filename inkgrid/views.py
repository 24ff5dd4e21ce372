"""Token, region and line views over the driver tables, in Spark and in DuckDB SQL.

Coordinates are whole numbers in doubles, so that sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENS = """
SELECT cast(floor(l_orderkey / 15.0e0) AS bigint) AS page,
       concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) AS token_id,
       (l_partkey % 90) * 10.0e0 AS x1, (l_suppkey % 25) * 40.0e0 + (l_linenumber % 3) * 4.0e0 AS y1,
       (l_partkey % 90) * 10.0e0 + 20.0e0 + l_quantity * 2.0e0 AS x2, (l_suppkey % 25) * 40.0e0 + (l_linenumber % 3) * 4.0e0 + 14.0e0 AS y2,
       1.0e0 - l_discount AS confidence, CASE WHEN l_partkey % 11 = 0 THEN cast(l_linenumber AS string) ELSE concat(l_returnflag, l_linestatus, cast(l_partkey % 7 AS string)) END AS text,
       CASE WHEN l_linenumber % 2 = 0 THEN 'native' ELSE 'ocr' END AS source
FROM lineitem
"""
REGIONS = """
SELECT cast(floor(p_partkey / 2.0e0) AS bigint) AS page, p_partkey AS region_id, (p_partkey * 37 % 60) * 10.0e0 AS x1, (p_partkey * 13 % 20) * 40.0e0 AS y1,
       (p_partkey * 37 % 60) * 10.0e0 + 150.0e0 + p_size * 4.0e0 AS x2, (p_partkey * 13 % 20) * 40.0e0 + 60.0e0 + (p_partkey % 5) * 30.0e0 AS y2
FROM part
"""
LINES = """
SELECT cast(floor(l_orderkey / 15.0e0) AS bigint) AS page,
       concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) AS line_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation,
       (l_suppkey % 25) * 40.0e0 + (l_linenumber % 3) * 3.0e0 AS axis, (l_partkey % 80) * 10.0e0 AS start, (l_partkey % 80) * 10.0e0 + l_quantity * 4.0e0 + 10.0e0 AS stop,
       1.0e0 - l_discount AS confidence
FROM lineitem
"""
PAGE_W, PAGE_H = 1200.0, 1000.0


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    source = sql.rsplit("FROM", 1)[1].strip()
    return spark.sql(sql.rsplit("FROM", 1)[0] + "FROM {t}", t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TOKENS)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, REGIONS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LINES)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL with the named views before it."""
    own = {"tokens": TOKENS, "regions": REGIONS, "lines": LINES}
    return "WITH " + ", ".join(f"{n} AS ({own[n].strip()})" for n in names) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
