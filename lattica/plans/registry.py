"""The queries of the graph engine by name, and their SQL."""

from __future__ import annotations

from lattica.plans import graph_queries, run_queries, table_queries

QUERIES = graph_queries.QUERIES | table_queries.QUERIES | run_queries.QUERIES
ORACLE_SQL = graph_queries.ORACLE_SQL | table_queries.ORACLE_SQL | run_queries.ORACLE_SQL
