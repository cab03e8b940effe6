"""Registered queries: operators bound to tables, each with the SQL that gives the same rows."""

from stewardry.plans import (  # noqa: F401
    correlation,
    dictionaries,
    imports,
    policies,
    texts,
    triage,
)
from stewardry.registry import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]
