"""Queries of this subpackage with their SQL counterparts."""

from __future__ import annotations

from siltstone.llm import key_queries, percentile_queries, term_queries, text_queries

_MODULES = [key_queries, percentile_queries, term_queries, text_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
