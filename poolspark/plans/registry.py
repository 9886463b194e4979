"""Named queries and the SQL text that gives the same rows on another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``ctes`` is put in front of ``sql`` as a WITH list."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {ctes}\n{sql}" if ctes else sql
        return fn

    return register
