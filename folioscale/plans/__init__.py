"""Named queries over the test tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from . import jobs, messages, pages, probes, search, sources

MODULES = (messages, pages, search, jobs, sources, probes)


def core_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def core_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
