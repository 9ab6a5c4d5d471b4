"""All queries of the core, and their oracle SQL."""

from __future__ import annotations

from ledgerloom.plans import finance, problems, questions, retrieval, textpipe, warehouse

FLAGSHIP = "fy_revenue_yoy"
_MODULES = (finance, warehouse, textpipe, retrieval, questions, problems)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
