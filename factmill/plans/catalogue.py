"""All queries: importing a module of queries registers them."""

from factmill.plans import case_queries, content_queries, profile_queries, queries, table_queries  # noqa: F401
from factmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
