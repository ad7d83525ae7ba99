"""Registry of named queries (one per operator id) and their oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame over the driver tables
or tables Spark derives from them. Doubles are rounded to 6 decimals in both the
Spark result and the SQL so the two engines hash alike.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries_core, queries_io, queries_model, queries_more  # noqa: F401
