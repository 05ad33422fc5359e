"""Penalised splines against NumPy, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions.smooth import SmoothBasis, _local, smooth
from strataflow.operators.smoothing import fit_smooth, smooth_values

BASES = [([0, 10, 25, 30, 60, 90, 100], 3), ([0, 1, 2], 2), ([0, 2, 3, 7, 8], 4), ([-5, 5], 2)]


def design(basis, times):
    out = np.zeros((len(times), basis.n))
    for row, t in zip(out, np.clip(times, basis.knots[0], basis.knots[-1]), strict=True):
        span = sum(t >= k for k in basis.knots[1:-1])
        row[span : span + basis.degree + 1] = _local(basis.full, basis.degree, span, t)
    return out


@pytest.mark.parametrize(("knots", "degree"), BASES)
def test_roughness_is_the_integral_of_squared_curvature(knots, degree):
    basis = SmoothBasis(knots, degree)
    c = np.cos(np.arange(basis.n) * 1.7)
    h, total = 1e-3 * min(np.diff(knots)), 0.0
    for a, b in zip(knots, knots[1:], strict=False):
        # Inside a span the curve is a polynomial; the rule is exact for the square of its second difference.
        x, w = np.polynomial.legendre.leggauss(6)
        t = a + (b - a) * (x + 1) / 2
        second = (design(basis, t + h) - 2 * design(basis, t) + design(basis, t - h)) @ c / h**2
        total += (b - a) / 2 * (w * second**2).sum()
    assert c @ basis.roughness @ c == pytest.approx(total, rel=1e-4)


@pytest.mark.parametrize(("knots", "degree"), BASES)
def test_lines_and_modes(knots, degree):
    basis = SmoothBasis(knots, degree)
    assert np.allclose(basis.modes.T @ basis.roughness @ basis.modes, np.eye(basis.n - 2)) and np.allclose(basis.lines.T @ basis.modes, 0)
    assert np.allclose(basis.roughness @ basis.lines, 0, atol=1e-9)
    times = np.linspace(knots[0], knots[-1], 30)
    line = basis.coefficients(2.0, -0.5, 0.0, [1.0] * (basis.n - 2))
    assert np.allclose(design(basis, times) @ line, 2.0 - 0.5 * (times - basis.middle))
    z = np.arange(basis.n - 2) - 1.0
    c = np.array(basis.coefficients(2.0, -0.5, 0.3, z, 7.0))
    assert c @ basis.roughness @ c == pytest.approx((0.3 / basis.scale(7.0)) ** 2 * (z @ z))


def test_bases_without_curvature_are_refused():
    for knots, degree in (([0, 10], 1), ([0], 3), ([0, 2, 2], 3), ([0, 1], 6)):
        with pytest.raises(Refused):
            SmoothBasis(knots, degree)
    with pytest.raises(Refused):
        SmoothBasis([0, 1, 2]).coefficients(0, 0, 1, [1.0])


@pytest.mark.parametrize(("knots", "degree"), BASES)
def test_fit_equals_dense_least_squares(spark, knots, degree):
    basis, rng = SmoothBasis(knots, degree), np.random.default_rng(degree)
    span = knots[-1] - knots[0]
    rows = [(g, float(t), float(np.sin(9 * t / span) + 0.1 * rng.normal()), float(rng.uniform(0.5, 2)), lam) for g, lam in (("a", 0.7), (None, 3.0)) for t in rng.uniform(knots[0] - 0.1 * span, knots[-1], 150)]
    rows += [("one time", knots[0] + 0.3, 2.0, 1.0, 1.0)] * 3 + [("nulls", None, 1.0, 1.0, 1.0), ("a", 1.0, None, 1.0, 0.7), ("a", 1.0, 5.0, None, 0.7)]
    df = spark.createDataFrame(rows, "g string, t double, y double, w double, lam double").repartition(3)
    fits = fit_smooth(df, ["g"], "t", "y", basis, F.col("lam"), "w")
    got = {r["g"]: r for r in fits.collect()}
    assert set(got) == {"a", None, "one time"} and got["one time"]["coefficients"] is None and got["one time"]["rss"] is None
    for g, lam in (("a", 0.7), (None, 3.0)):
        t, y, w = (np.array(x) for x in zip(*[r[1:4] for r in rows if r[0] == g and None not in r[1:4]], strict=True))
        x = design(basis, t)
        c = np.linalg.solve(x.T @ (w[:, None] * x) + lam * basis.roughness, x.T @ (w * y))
        r = got[g]
        assert np.allclose(r["coefficients"], c, atol=1e-9) and r["n"] == 150
        assert np.allclose(basis.lines @ [r["level"], r["slope"]] + basis.modes @ np.array(r["modes"]), c)
        assert r["roughness"] == pytest.approx(sum(z * z for z in r["modes"])) and r["rss"] == pytest.approx((w * (y - x @ c) ** 2).sum())
    values = smooth_values(df.where("t is not null"), fits, ["g"], "t", basis).collect()
    assert len(values) == len(rows) - 1 and all((v["fitted"] is None) == (v["g"] in ("one time", "nulls")) for v in values)
    values = [v for v in values if v["g"] == "a"]
    assert np.allclose([v["fitted"] for v in values], design(basis, [v["t"] for v in values]) @ got["a"]["coefficients"])


def test_fit_without_strata_and_rows(spark):
    basis = SmoothBasis([0, 5, 10])
    df = spark.createDataFrame([(float(t), 3.0 + 2.0 * t) for t in range(11)], "t double, y double")
    (r,) = fit_smooth(df, [], "t", "y", basis, 100.0).collect()
    # A line has no roughness, so no penalty bends it.
    assert (r["level"], r["slope"]) == pytest.approx((13.0, 2.0)) and r["rss"] == pytest.approx(0, abs=1e-6)
    assert fit_smooth(df.withColumn("k", F.lit(1)).limit(0), ["k"], "t", "y", basis, 1.0).count() == 0


def test_smooth_forcing_is_its_spline(spark):
    basis, z = SmoothBasis([0, 10, 30, 60, 100]), [1.0, 0.0, -1.0, 2.0, 0.5]
    times = [-5.0, 0.0, 12.5, 30.0, 99.9, 100.0, 120.0]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t double").select(smooth(F.col("t"), basis, 1.0, 0.1, 0.5, z, 7.0)).collect()]
    assert np.allclose(got, design(basis, times) @ basis.coefficients(1.0, 0.1, 0.5, z, 7.0))
