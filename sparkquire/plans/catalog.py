"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from ..operators import chunking, files, geometry, graph, jobs, manifest, records, scalars, tablestore, tools, views  # noqa: F401  each module registers its own
from ..streaming import feeds  # noqa: F401
from . import registry


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
