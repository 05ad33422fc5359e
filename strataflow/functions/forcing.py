"""Forcings: scalar functions of time as column expressions, and the same as joins for series held in tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sinusoid(t: Column, base: float, amplitude: float, period: float, phase: float = 0.0) -> Column:
    return base + amplitude * F.sin(2 * math.pi * (t - phase) / period)


def piecewise(t: Column, breaks: Sequence[float], values: Sequence[float]) -> Column:
    """Step function, closed on the left; the first value holds before the first break."""
    if len(values) != len(breaks) + 1:
        raise ValueError("one more value than breaks is needed")
    out = F.lit(float(values[0]))
    for b, v in zip(breaks, values[1:], strict=True):
        out = F.when(t >= b, F.lit(float(v))).otherwise(out)
    return out


def linear(t: Column, times: Sequence[float], values: Sequence[float]) -> Column:
    """Linear between knots, held at both ends."""
    out = F.lit(float(values[-1]))
    for (t0, v0), (t1, v1) in reversed(list(zip(zip(times, values), zip(times[1:], values[1:]), strict=False))):
        out = F.when(t < t1, v0 + (t - t0) * ((v1 - v0) / (t1 - t0))).otherwise(out)
    return F.when(t <= times[0], F.lit(float(values[0]))).otherwise(out)


def previous(t: Column, times: Sequence[float], values: Sequence[float]) -> Column:
    """Value of the knot at or before t; the first value holds before it."""
    return piecewise(t, list(times[1:]), list(values))


def natural_spline(t: Column, times: Sequence[float], values: Sequence[float]) -> Column:
    """Natural cubic spline, held at both ends; two knots give a line.  Knots must increase."""
    x, y, n = list(map(float, times)), list(map(float, values)), len(times)
    if any(b <= a for a, b in zip(x, x[1:], strict=False)):
        raise ValueError("knots must increase strictly")
    if n == 2:
        return linear(t, x, y)
    h = [b - a for a, b in zip(x, x[1:], strict=False)]
    # Second derivatives at the inner knots: a tridiagonal system, eliminated forwards.
    diag, right = [], []
    for i in range(1, n - 1):
        d, r = 2 * (h[i - 1] + h[i]), 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        if diag:
            f = h[i - 1] / diag[-1]
            d, r = d - f * h[i - 1], r - f * right[-1]
        diag.append(d)
        right.append(r)
    m = [0.0] * n
    for i in range(n - 2, 0, -1):
        m[i] = (right[i - 1] - h[i] * m[i + 1]) / diag[i - 1]
    out = F.lit(y[-1])
    for i in range(n - 2, -1, -1):
        u = t - x[i]
        slope = (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
        out = F.when(t < x[i + 1], y[i] + u * (slope + u * (m[i] / 2 + u * ((m[i + 1] - m[i]) / (6 * h[i]))))).otherwise(out)
    return F.when(t <= x[0], F.lit(y[0])).otherwise(out)


def wrapped(t: Column, period: float) -> Column:
    """t modulo the period, in [0, period)."""
    return t - period * F.floor(t / period)


def periodic(t: Column, period: float, values: Sequence[float]) -> Column:
    """One value per equal bin of the period; the last bin takes what rounding would push past the end."""
    n = len(values)
    i = F.least(F.floor(wrapped(t, period) * n / period), F.lit(n - 1))
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i + 1).cast("int"))


def fourier(t: Column, period: float, terms: Sequence[tuple[float, float]]) -> Column:
    """Sum of a_k cos(k w t) + b_k sin(k w t), without a baseline; 0 where the period is not positive."""
    if period <= 0:
        return F.lit(0.0)
    w = 2 * math.pi * t / period
    return sum((a * F.cos(k * w) + b * F.sin(k * w) for k, (a, b) in enumerate(terms, 1)), F.lit(0.0))


def b_spline(t: Column, knots: Sequence[float], degree: int, coefficients: Sequence[float]) -> Column:
    """B-spline on an open knot vector, end values held; Cox-de Boor recursion unrolled to columns."""
    if degree > 5:
        raise ValueError("degrees up to 5 are supported")
    full = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    if len(coefficients) != len(full) - degree - 1:
        raise ValueError(f"{len(full) - degree - 1} coefficients are needed")
    lo, hi = float(knots[0]), float(knots[-1])
    inner = F.least(F.greatest(t, F.lit(lo)), F.lit(hi))
    out = F.lit(float(coefficients[-1]))
    # On each span only degree + 1 basis functions are alive: evaluate their polynomial by de Boor's scheme.
    for s in range(len(full) - degree - 2, degree - 1, -1):
        if full[s] == full[s + 1]:
            continue
        d = [F.lit(float(coefficients[s - degree + j])) for j in range(degree + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                left, right = full[j + s - degree], full[j + 1 + s - r]
                alpha = (inner - left) / (right - left)
                d[j] = (1 - alpha) * d[j - 1] + alpha * d[j]
        out = F.when(inner < full[s + 1], d[degree]).otherwise(out)
    return out


def periodic_b_spline(t: Column, period: float, coefficients: Sequence[float], degree: int = 3, log_link: bool = False) -> Column:
    """Uniform periodic B-spline: one coefficient per knot of the period."""
    n = len(coefficients)
    u = wrapped(t, period) * n / period
    span = F.floor(u)
    x = u - span
    # Weights of the degree + 1 neighbouring coefficients within a unit span.
    weights = [F.lit(1.0)]
    for k in range(1, degree + 1):
        grown = []
        for j in range(k + 1):
            rise = (x + (k - j)) / k * weights[j - 1 if j else 0] if j else F.lit(0.0)
            fall = (1 - x + j) / k * weights[j] if j < k else F.lit(0.0)
            grown.append(rise + fall)
        weights = grown
    ring = F.array(*[F.lit(float(c)) for c in coefficients])
    terms = [w * F.element_at(ring, (F.pmod(span + j, F.lit(n)) + 1).cast("int")) for j, w in enumerate(weights)]
    out = sum(terms[1:], terms[0])
    return F.exp(out) if log_link else out


def lagged(f, t: Column, lag: float, *args, **kwargs) -> Column:
    """Any forcing at t - lag."""
    return f(t - lag, *args, **kwargs)


def inside(t: Column, lo: float, hi: float, f: Callable[[Column], Column], hold: bool = False) -> tuple[Column, Column]:
    """(value, was_held) of a forcing: outside [lo, hi] it is refused, or held at the value of the nearer end and flagged."""
    out = (t < lo) | (t > hi)
    if hold:
        return f(F.least(F.greatest(t, F.lit(float(lo))), F.lit(float(hi)))), out
    return F.when(out, F.raise_error(F.lit("evaluated outside the forcing's range")).cast("double")).otherwise(f(t)), F.lit(False)


def on_ranges(t: Column, period: float, ranges: Sequence[tuple[float, float]]) -> Column:
    """1.0 inside any of the half-open ranges of the period, else 0.0."""
    u = wrapped(t, period)
    on = F.lit(False)
    for a, b in ranges:
        on = on | ((u >= a) & (u < b))
    return on.cast("double")


def join_series(points: DataFrame, knots: DataFrame, by: list[str], kind: str = "linear") -> DataFrame:
    """Adds ``value`` at each point's ``t`` from rows (by, time, value) of knots: one series per stratum.

    Knots become half-open spans, points and knots are merged in time order, and each point takes the span that is open there,
    by scans in which one stratum may hold most of the rows.  A stratum without knots fails the job.
    """
    from strataflow.operators.scan import scanned

    known = scanned(knots.select(*by, "time", F.col("value").cast("double").alias("value"), F.struct("time", "value").alias("_at")), by, [F.col("time").desc()], {"_next": ("before", "_at")})
    span = F.struct(F.col("time").alias("t0"), F.col("value").alias("v0"), F.col("_next.time").alias("t1"), F.col("_next.value").cast("double").alias("v1"))
    marks = known.select(*by, F.col("time").alias("t"), F.lit(0).alias("_k"), span.alias("_span"))
    # Before its first knot, a series has that knot's value.
    first = known.groupBy(*by).agg(F.min("time").alias("t0"), F.min_by("value", "time").alias("v0"))
    held = F.struct("t0", "v0", F.lit(None).cast(marks.schema["_span"].dataType["t1"].dataType).alias("t1"), F.lit(None).cast("double").alias("v1"))
    low = first.select(*by, F.lit(None).cast(marks.schema["t"].dataType).alias("t"), F.lit(-1).alias("_k"), held.alias("_span"))
    asked = points.select(*by, "t", F.lit(1).alias("_k"), F.lit(None).cast(marks.schema["_span"].dataType).alias("_span"), F.struct(*points.columns).alias("_row"))
    both = marks.unionByName(low).withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    both = scanned(both, by, [F.col("t").asc_nulls_first(), F.col("_k").asc()], {"_open": ("last", "_span")}).where(F.col("_row").isNotNull())
    s, t = F.col("_open"), F.col("_row.t")
    along = s["v0"] + (t - s["t0"]) * F.try_divide(s["v1"] - s["v0"], s["t1"] - s["t0"])
    value = F.when((t <= s["t0"]) | s["t1"].isNull(), s["v0"]).otherwise(along) if kind == "linear" else s["v0"]
    lost = F.raise_error(F.concat(F.lit("a stratum without knots: "), F.to_json(F.struct(*by) if by else F.struct(F.lit(0))))).cast("double")
    return both.select("_row.*", F.when(s.isNull(), lost).when(t.isNotNull(), value).alias("value"))
