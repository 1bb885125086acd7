"""Registry of runnable queries and the SQL that states their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Common table expressions of the SQL statements.
EV = """ev AS (
  SELECT event_id, user_id AS mouse, epoch_us(ts) / 1e6 AS t, event_type AS kind, value AS v
  FROM events)"""
