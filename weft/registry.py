"""Query registry: one decorator, two dictionaries.

Every query is a function ``(spark, sf_dir) -> DataFrame``.  ``oracle`` is the DuckDB SQL that
returns the same rows from the same tables; it is left out where SQL cannot express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``key``; a key may be registered once only."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register
