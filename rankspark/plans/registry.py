"""Registry of the driver's queries, their SQL twins and the inventory lines they cover."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(key: str, covers: str, sql: str | None = None):
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        COVERS[key] = covers
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return wrap
