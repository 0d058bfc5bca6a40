"""All registered queries of the engine and their SQL."""

from . import function_queries, growth_queries, queries, relation_queries  # noqa: F401

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
