"""All queries of the engine and the SQL that each must agree with."""

from . import code_queries, fixture_queries, graph_queries, relational_queries, search_queries  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
