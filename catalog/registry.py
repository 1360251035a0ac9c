"""Named queries with, where SQL can say it, the DuckDB text for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from catalog.present import present
from catalog.workspace import Workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def run(name: str, spark, sf_dir: str) -> DataFrame:
    return present(QUERIES[name](Workspace(spark, sf_dir)))
