"""Arithmetic with explicit rules for degenerate arguments.

``strict`` raises, ``zero`` gives 0, ``null`` gives a missing value, ``ieee`` follows floating point (0/0 is NaN).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("strict", "zero", "null", "ieee")


def _guard(bad: Column, value: Column, mode: str, what: str) -> Column:
    if mode == "strict":
        return F.when(bad, F.raise_error(F.lit(what)).cast("double")).otherwise(value)
    if mode == "zero":
        return F.when(bad, F.lit(0.0)).otherwise(value)
    if mode == "null":
        return F.when(bad, F.lit(None).cast("double")).otherwise(value)
    raise ValueError(f"mode must be one of {MODES}")


def divide(a: Column, b: Column, mode: str = "strict") -> Column:
    a, b = a.cast("double"), b.cast("double")
    if mode == "ieee":
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        zero = F.when((a == 0) | F.isnan(a), nan).otherwise(F.when(a > 0, inf).otherwise(-inf))
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
    return _guard(b == 0, F.try_divide(a, b), mode, "division by zero")


def power(a: Column, b: Column, mode: str = "strict") -> Column:
    out = F.pow(a.cast("double"), b.cast("double"))
    if mode == "ieee":
        return out
    return _guard(F.isnan(out) | (F.abs(out) == float("inf")), out, mode, "power is not finite")


def modulo(a: Column, b: Column, mode: str = "strict") -> Column:
    """Remainder that is never negative."""
    a, b = a.cast("double"), F.abs(b.cast("double"))
    rest = F.try_mod(F.try_mod(a, b) + b, b)
    return _guard(b == 0, rest, "null" if mode == "ieee" else mode, "modulus of zero")


def square_root(a: Column, mode: str = "strict") -> Column:
    a = a.cast("double")
    return F.sqrt(a) if mode == "ieee" else _guard(a < 0, F.sqrt(F.greatest(a, F.lit(0.0))), mode, "square root of a negative number")


def logarithm(a: Column, mode: str = "strict") -> Column:
    a = a.cast("double")
    if mode == "ieee":
        return F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.log(a))
    return _guard(a <= 0, F.log(a), mode, "logarithm of a number that is not positive")


def finite(a: Column) -> Column:
    """Neither missing, NaN nor infinite."""
    return a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))
