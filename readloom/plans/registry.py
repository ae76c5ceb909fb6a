"""Registry of queries: each is a function of (spark, sf_dir), with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a function under its name; sql may use the views named (see fixtures.VIEWS)."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = fixtures.sql(sql, *views)
        return f

    return add
