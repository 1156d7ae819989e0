"""All queries of the engine proper."""

from __future__ import annotations

from siltstone.plans import documents, exporting, graphs, records, registry, retrieval

_MODULES = (documents, retrieval, graphs, exporting, records)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
