"""Registered queries over the benchmark tables."""

from eventide.workload import (  # noqa: F401
    align_queries,
    analysis_queries,
    event_queries,
    model_queries,
    plan_queries,
    table_queries,
)
from eventide.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
