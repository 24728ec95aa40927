"""All queries of the library and their SQL."""

from __future__ import annotations

from brindle.plans import file_queries, queries, rule_queries

__all__ = ["QUERIES", "ORACLE_SQL", "file_queries", "rule_queries"]
QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
