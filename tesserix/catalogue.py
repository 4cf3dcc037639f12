"""Every query of the library by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from .plans import association_queries, model_queries, packed_queries


def queries() -> dict:
    return association_queries.QUERIES | model_queries.QUERIES | packed_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return association_queries.SQL | model_queries.SQL | packed_queries.SQL
