"""Registered queries: one per operator, each with the SQL it must agree with where SQL can say it."""

from suite import exploring, integration, lookups, nested, predicates, quality, stored, variants  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
