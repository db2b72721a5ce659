"""Query catalogue: one Spark query per operator, each with its DuckDB oracle.

Every query reads the driver tables of ``sf_dir`` (through the adapters) so
its work grows with them. Computed doubles are rounded to 6 places on both
sides; counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
_LAZY: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    """Register a query; ``oracle`` is its SQL, or makes it once all modules are loaded."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if callable(oracle):
            _LAZY[name] = oracle
        elif oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from hotspots.plans import (queries_core, queries_ingest, queries_model,  # noqa: F401
                                queries_scoring, queries_views)
    while _LAZY:
        name, make = _LAZY.popitem()
        ORACLE[name] = make()
