"""Registered queries over the driver tables, each with its SQL counterpart.

A query takes (spark, sf_dir) and returns a DataFrame; its SQL gives the same
rows on any engine that has the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Import all query modules."""
    from rasterweave.catalog import frames, scores, series, simulation, stored, streams  # noqa: F401
