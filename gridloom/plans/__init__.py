"""Queries over the given tables."""

from gridloom.plans.registry import REGISTRY
from gridloom.plans import queries_compare, queries_fields, queries_jobs, queries_skill  # noqa: F401

__all__ = ["REGISTRY"]
