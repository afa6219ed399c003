"""Query catalogue and plan inspection."""

from .catalogue import BY_NAME, CATALOGUE, Query, oracle_sql, queries

__all__ = ["BY_NAME", "CATALOGUE", "Query", "oracle_sql", "queries"]
