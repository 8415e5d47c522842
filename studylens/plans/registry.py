"""Registered queries: a Spark callable by name and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_MODULES = ("daily", "paths", "concentration", "ratings", "progression", "audit", "classroom", "evidence", "ingest", "slices", "metadata", "topology")


def register(name: str, sql: str | None = None):
    """Decorator: adds ``f(spark, sf_dir)`` under ``name``, with its SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


for _module in _MODULES:
    importlib.import_module(f"studylens.plans.{_module}")
