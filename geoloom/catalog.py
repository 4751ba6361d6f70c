"""Every registered query of the engine, and its SQL."""

from __future__ import annotations

from .plans import evaluation, harvest, integrity, model, provenance, rasters, records, retrieval, scoring, streams, tiles  # noqa: F401
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
