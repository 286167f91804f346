"""All queries of the core, by name."""

from __future__ import annotations

from nodeweave.queries import graph_queries, metric_queries, nested, pipeline_queries, training_queries, vector_queries

MODULES = (vector_queries, graph_queries, metric_queries, pipeline_queries, training_queries, nested)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES if hasattr(m, "oracle_sql") for name, sql in m.oracle_sql().items()}
