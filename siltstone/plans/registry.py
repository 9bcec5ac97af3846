"""All queries outside the subpackage for training data."""

from __future__ import annotations

from siltstone.plans import changelog_queries, fulltext_queries, store_queries, upsert_queries

_MODULES = [upsert_queries, changelog_queries, fulltext_queries, store_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
