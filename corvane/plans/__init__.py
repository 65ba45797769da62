"""Registered queries and their SQL counterparts."""

from corvane.plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
