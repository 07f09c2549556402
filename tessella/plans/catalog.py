"""All named queries and their SQL twins."""

from __future__ import annotations

from . import change_queries, flow_queries, graph_queries, layout_queries, rule_queries, task_queries, text_queries, view_queries  # noqa: F401
from .registry import as_callables, as_sql


def queries() -> dict:
    return as_callables()


def oracle_sql() -> dict[str, str]:
    return as_sql()
