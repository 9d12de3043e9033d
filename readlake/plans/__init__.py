"""Registered queries with the SQL they are held against."""

from __future__ import annotations

import importlib

_MODULES = ("text", "tables", "rebuild", "article", "events", "files")


def all_queries() -> tuple[dict, dict]:
    """Every query of this package's modules, and the oracle SQL of those that SQL can express."""
    queries, oracle = {}, {}
    for name in _MODULES:
        registry = importlib.import_module(f"readlake.plans.{name}").registry
        queries |= registry.queries
        oracle |= registry.oracle
    return queries, oracle
