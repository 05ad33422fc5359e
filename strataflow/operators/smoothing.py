"""Least squares with a roughness penalty, for every stratum at once.

A row touches degree + 1 basis functions, so the normal equations are banded.  One aggregation by stratum and knot span sums
their products, map-side first, whatever the number of rows of a stratum; what is left is one row per span, and the banded
system of a stratum is solved by an L D L' elimination in its row's arrays.  No row leaves the JVM.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.smooth import SmoothBasis


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normal_equations(df: DataFrame, by: list[str], time: str, value: str, basis: SmoothBasis, weight: str | None = None) -> DataFrame:
    """One row per stratum: ``n``, ``yy`` and ``spans``, an array with the sums of each knot span: ``g`` (products of functions r <= q)
    and ``h`` (products with the value).  Rows with a null time, value or weight are left out."""
    p = basis.degree
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    y = F.col(value).cast("double")
    span, values = basis.at(F.col(time).cast("double"))
    rows = df.where(F.col(time).isNotNull() & y.isNotNull() & w.isNotNull())
    rows = rows.select(*by, span.alias("_s"), w.alias("_w"), y.alias("_y"), *[v.alias(f"_b{r}") for r, v in enumerate(values)])
    b = [F.col(f"_b{r}") for r in range(p + 1)]
    products = [F.sum(F.col("_w") * b[r] * b[q]).alias(f"_g{r}_{q}") for r in range(p + 1) for q in range(r, p + 1)]
    right = [F.sum(F.col("_w") * b[r] * F.col("_y")).alias(f"_h{r}") for r in range(p + 1)]
    sums = rows.groupBy(*by, "_s").agg(*products, *right, F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_yy"), F.count("*").alias("_n"))
    g = F.array(*[F.col(f"_g{r}_{q}") for r in range(p + 1) for q in range(r, p + 1)])
    h = F.array(*[F.col(f"_h{r}") for r in range(p + 1)])
    # As many entries as there are knot spans.
    packed = sums.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_yy").alias("yy"), F.map_from_entries(F.collect_list(F.struct("_s", F.struct(g.alias("g"), h.alias("h"))))).alias("_spans"))
    return packed.withColumn("spans", F.transform(F.sequence(F.lit(0), F.lit(basis.n_spans - 1)), lambda s: F.try_element_at("_spans", s))).drop("_spans")


def _band(basis: SmoothBasis, penalty: Column) -> Column:
    """Array of rows i of the system: ``a`` (entries i .. i + degree) and ``y`` (right side)."""
    p, spans = basis.degree, F.col("spans")
    place = {(r, q): k for k, (r, q) in enumerate((r, q) for r in range(p + 1) for q in range(r, p + 1))}
    omega = F.array(*[_numbers([basis.roughness[i, i + d] if i + d < basis.n else 0.0 for d in range(p + 1)]) for i in range(basis.n)])

    def row(i: Column) -> Column:
        entry = lambda r, field, k: F.coalesce(F.get(F.get(spans, i - r)[field], F.lit(k)), F.lit(0.0))
        a = [sum((entry(r, "g", place[r, r + d]) for r in range(p + 1 - d)), F.lit(0.0)) + penalty * F.get(F.get(omega, i), F.lit(d)) for d in range(p + 1)]
        return F.struct(F.array(*a).alias("a"), sum((entry(r, "h", r) for r in range(p + 1)), F.lit(0.0)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(basis.n - 1)), row)


def _solved(band: Column, degree: int) -> Column:
    """Coefficients of a banded symmetric system; null where a pivot is not positive, so that the system has no one solution."""
    p = degree
    kind = "struct<u: array<double>, d: double, z: double>"
    zero = F.struct(_numbers([0] * p).alias("u"), F.lit(1.0).alias("d"), F.lit(0.0).alias("z"))
    start = F.struct(F.array(*[zero] * p).alias("recent"), F.array().cast(f"array<{kind}>").alias("done"))

    def eliminate(state: Column, row: Column) -> Column:
        before = [F.get(state["recent"], F.lit(k)) for k in range(p)]
        u = lambda k, j: F.get(before[k]["u"], F.lit(j))
        d = row["a"][0] - sum((u(k, k) * u(k, k) * before[k]["d"] for k in range(p)), F.lit(0.0))
        # A pivot that rounding alone can leave is none.
        pivot = F.when(d > 1e-12 * row["a"][0], d)
        above = [(row["a"][j] - sum((u(k, k) * u(k, k + j) * before[k]["d"] for k in range(p - j)), F.lit(0.0))) / pivot for j in range(1, p + 1)]
        z = row["y"] - sum((u(k, k) * before[k]["z"] for k in range(p)), F.lit(0.0))
        new = F.struct(F.array(*above).alias("u"), pivot.alias("d"), z.alias("z"))
        return F.struct(F.slice(F.concat(F.array(new), state["recent"]), 1, p).alias("recent"), F.concat(state["done"], F.array(new)).alias("done"))

    done = F.aggregate(band, start, eliminate)["done"]
    back = lambda c, row: F.concat(F.array(row["z"] / row["d"] - sum((F.get(row["u"], F.lit(j)) * F.coalesce(F.get(c, F.lit(j)), F.lit(0.0)) for j in range(p)), F.lit(0.0))), c)
    out = F.aggregate(F.reverse(done), F.array().cast("array<double>"), back)
    return F.when(F.forall(done, lambda r: r["d"].isNotNull()), out)


def fit_smooth(df: DataFrame, by: list[str], time: str, value: str, basis: SmoothBasis, penalty: float | Column, weight: str | None = None) -> DataFrame:
    """One row per stratum with the curve that has the least  sum w (y - g(t))^2 + penalty * roughness(g).

    ``coefficients``; ``level`` and ``slope`` (the curve's line at mid-window) and ``modes`` (the rest, each of roughness 1);
    ``roughness``, ``rss`` and ``n``.  ``penalty`` may be a column of the strata.  A stratum whose rows don't determine the curve
    (such as one time alone) has null coefficients.
    """
    import numpy as np

    # A penalty that is a column is constant in a stratum and so part of its key.
    fixed = isinstance(penalty, int | float)
    used = F.lit(float(penalty)) if fixed else F.col("_penalty")
    eq = normal_equations(df if fixed else df.withColumn("_penalty", penalty.cast("double")), by if fixed else [*by, "_penalty"], time, value, basis, weight)
    # Written once into a column of its own: the elimination reads it many times.
    eq = eq.withColumn("band", _band(basis, used)).withColumn("coefficients", _solved(F.col("band"), basis.degree))
    c = F.col("coefficients")
    line = np.linalg.pinv(basis.lines)
    omega = F.array(*[_numbers(r) for r in basis.roughness])
    eq = eq.withColumns({
        "level": _dot(_numbers(line[0]), c), "slope": _dot(_numbers(line[1]), c), "modes": F.transform(F.array(*[_numbers(r) for r in basis.to_modes]), lambda r: _dot(r, c)),
        "roughness": _dot(c, F.transform(omega, lambda r: _dot(r, c))), "_fit": _dot(c, F.transform("band", lambda r: r["y"])),
    })
    rss = F.greatest(F.col("yy") - F.col("_fit") - used * F.col("roughness"), F.lit(0.0))
    return eq.select(*by, "n", "coefficients", "level", "slope", "modes", "roughness", F.when(c.isNotNull(), rss).alias("rss"))


def smooth_values(points: DataFrame, fits: DataFrame, by: list[str], time: str, basis: SmoothBasis, out: str = "fitted") -> DataFrame:
    """Adds the fitted value of each point; null for strata without a fit.  There is one row of fits per stratum."""
    known = fits.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("coefficients").alias("_c"))
    same = functools.reduce(lambda a, b: a & b, [points[c].eqNullSafe(known[f"_k_{c}"]) for c in by], F.lit(True))
    joined = points.join(known, same, "left").drop(*[f"_k_{c}" for c in by])
    span, values = basis.at(F.col(time).cast("double"))
    return joined.withColumn(out, sum((v * F.get("_c", span + r) for r, v in enumerate(values)), F.lit(0.0))).drop("_c")
