"""All queries over the driver tables, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def both(sql: str) -> Callable[[Query], Query]:
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace(" AS string)", " AS varchar)")
        return f

    return add


def spark_only(f: Query) -> Query:
    """Registers a query that SQL can't express; tests hold it against a plain model."""
    QUERIES[f.__name__] = f
    return f


from . import queries_layout, queries_records  # noqa: E402, F401, I001
from . import queries_more  # noqa: E402, F401
