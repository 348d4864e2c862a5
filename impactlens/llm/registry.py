"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from impactlens.plans.registry import Query
from impactlens.session import tune

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register
