"""Named queries over the test tables, each with the SQL that gives the same rows."""

from graphloom.plans import graph_queries, loyalty_queries, operator_queries, score_queries, store_queries, table_queries  # noqa: F401
from graphloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
