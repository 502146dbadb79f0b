"""Queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from logweave.plans import analytics_queries, engine_queries, store_queries  # noqa: F401
from logweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
