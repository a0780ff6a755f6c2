"""Named queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from . import registry
from .plans import composite, content, corpus, enrich, quality, retrieval, service  # noqa: F401  (each registers its queries)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
