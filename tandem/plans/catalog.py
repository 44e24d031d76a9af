"""Registry of named queries: Spark implementation + DuckDB oracle SQL.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Every query reads the driver's tables (through the ``games`` view or the
``events`` table), so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # importing the modules registers their queries
    from tandem.plans import queries_core, queries_eval, queries_features, queries_ml, queries_sources  # noqa: F401
    from tandem.plans import queries_jobs, queries_stream  # noqa: F401  (after the batch queries they reuse)
    return QUERIES
