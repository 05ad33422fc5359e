"""Queries over the driver's tables, one or more per operator family, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Query(f, sql)
        return f

    return add


from strataflow.queries import dynamics, evidence, files, hierarchy, lineages, regression, relational, series, smoothing, statistics  # noqa: E402, F401
