"""Refusals: operators return violations as data; the caller may turn them into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Refused(ValueError):
    """Input that the engine declines to compute on."""


def refuse_any(violations: DataFrame, message: str) -> None:
    """Raise with one example if there is any violation."""
    row = violations.limit(1).collect()
    if row:
        raise Refused(f"{message}: {row[0].asDict()}")
