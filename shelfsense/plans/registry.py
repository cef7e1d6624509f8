"""Registry of the test-bound queries: one Spark builder and one oracle SQL per key.

``__spark_entry__`` exposes :data:`QUERIES` and :data:`ORACLES`.  A query
without an oracle (ML, sketches, approximate joins) is registered with
``sql=None`` and gets the driver's rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    from . import (q_aggs, q_clean, q_flagship, q_ml, q_relational, q_safety, q_series, q_similarity,  # noqa: F401
                   q_retail, q_sources, q_streaming,
                   q_stock, q_text)
