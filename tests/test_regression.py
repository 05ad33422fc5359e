"""Derivatives against differences of the densities, and fits by Newton steps against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions import density, gradient
from strataflow.functions.special import digamma, trigamma
from strataflow.operators.regression import fit_newton

V = F.lit
CASES = {
    "poisson": (lambda y, t: density.poisson(y, t), gradient.poisson, [0, 3, 12], [0.7, 4.5]),
    "negative_binomial_mean": (lambda y, t: density.negative_binomial(y, t, V(2.5)), lambda y, t: gradient.negative_binomial_mean(y, t, V(2.5)), [0, 3, 12], [0.7, 4.5]),
    "negative_binomial_size": (lambda y, t: density.negative_binomial(y, V(3.0), t), lambda y, t: gradient.negative_binomial_size(y, V(3.0), t), [0, 3, 12], [0.7, 4.5]),
    "zero_inflated": (lambda y, t: density.zero_inflated_negative_binomial(y, t, V(2.5), V(0.3)), lambda y, t: gradient.zero_inflated_negative_binomial_mean(y, t, V(2.5), V(0.3)), [0, 3], [0.7, 4.5]),
    "normal_mean": (lambda y, t: density.normal(y, t, V(2.0)), lambda y, t: gradient.normal_mean(y, t, V(2.0)), [-1.5, 3], [0.7, 4.5]),
    "normal_sd": (lambda y, t: density.normal(y, V(1.0), t), lambda y, t: gradient.normal_sd(y, V(1.0), t), [-1.5, 3], [0.7, 4.5]),
    "discretised_normal": (lambda y, t: density.discretised_normal(y, t, V(4.0)), lambda y, t: gradient.discretised_normal_mean(y, t, V(4.0)), [0, 3, 9], [0.7, 4.5]),
    "binomial": (lambda y, t: density.binomial(y, V(12), t), lambda y, t: gradient.binomial(y, V(12), t), [0, 5, 12], [0.2, 0.8]),
    "bernoulli": (lambda y, t: density.bernoulli(y, t), gradient.bernoulli, [0, 1], [0.2, 0.8]),
    "beta_binomial": (lambda y, t: density.beta_binomial(y, V(12), t * 5, (1 - t) * 5), lambda y, t: gradient.beta_binomial_mean(y, V(12), t, V(5.0)), [0, 5, 12], [0.2, 0.8]),
    "beta": (lambda y, t: density.beta(y, t, V(5.0)), lambda y, t: gradient.beta_mean(y, t, V(5.0)), [0.1, 0.6], [0.2, 0.8]),
}


@pytest.mark.parametrize("name", CASES)
def test_derivatives_are_those_of_the_density(spark, name):
    value, derivative, ys, ts = CASES[name]
    rows = spark.createDataFrame([(float(y), float(t)) for y in ys for t in ts], "y double, t double")
    y, t, h = F.col("y"), F.col("t"), 1e-3
    at = [value(y, t + k * h).alias(f"l{k + 2}") for k in range(-2, 3)]
    first, second = derivative(y, t)
    for r in rows.select("y", "t", *at, first.alias("d1"), second.alias("d2")).collect():
        d1 = (r["l0"] - 8 * r["l1"] + 8 * r["l3"] - r["l4"]) / (12 * h)
        d2 = (-r["l0"] + 16 * r["l1"] - 30 * r["l2"] + 16 * r["l3"] - r["l4"]) / (12 * h * h)
        assert r["d1"] == pytest.approx(d1, rel=1e-6, abs=1e-7) and r["d2"] == pytest.approx(d2, rel=1e-5, abs=1e-5), r


def test_derivatives_are_null_where_the_density_has_none(spark):
    bad = spark.createDataFrame([(-1.0, 2.0), (1.0, 0.0), (math.nan, 2.0), (1.0, math.nan), (None, 2.0)], "y double, t double")
    for pair in (gradient.poisson(F.col("y"), F.col("t")), gradient.beta_mean(F.col("y"), F.col("t"), V(2.0)), gradient.bernoulli(F.col("y"), F.col("t")), gradient.binomial(F.col("y"), V(3), F.col("t"))):
        assert all(r[0] is None and r[1] is None for r in bad.select(*pair).collect())


def test_digamma_and_trigamma(spark):
    row = spark.range(1).select(digamma(V(1.0)).alias("a"), trigamma(V(1.0)).alias("b"), trigamma(V(0.5)).alias("c")).first()
    assert row["a"] == pytest.approx(-0.5772156649015329, abs=1e-10) and row["b"] == pytest.approx(math.pi**2 / 6, abs=1e-12) and row["c"] == pytest.approx(math.pi**2 / 2, abs=1e-12)


def dense_newton(x, y, mean, slope_weight, start):
    """Canonical links: gradient x'(y - m), information x' W x."""
    c = start
    for _ in range(50):
        m = mean(x @ c)
        c = c + np.linalg.solve(x.T @ (slope_weight(m)[:, None] * x), x.T @ (y - m))
    return c


def test_fits_by_stratum_equal_dense_newton(spark):
    rng = np.random.default_rng(5)
    data = {}
    for k, n in (("hot", 3000), (None, 200), ("b", 60)):
        x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
        data[k] = x, rng.poisson(np.exp(x @ [0.5, 0.8, -0.4])), (rng.random(n) < 1 / (1 + np.exp(-x @ [0.2, 1.0, -0.5]))).astype(float)
    rows = [(k, float(y), float(z), float(a), float(b)) for k, (x, ys, zs) in data.items() for (_, a, b), y, z in zip(x, ys, zs, strict=True)]
    df = spark.createDataFrame([*rows, ("hot", None, None, 1.0, 1.0)], "k string, y double, z double, a double, b double")
    for r in fit_newton(df, ["k"], "y", ["a", "b"], "poisson", "log").collect():
        x, ys, _ = data[r["k"]]
        want = dense_newton(x, ys, np.exp, lambda m: m, np.zeros(3))
        assert r["converged"] and r["n"] == len(x) and r["coefficients"] == pytest.approx(list(want), rel=1e-8), r["k"]
        assert max(map(abs, r["gradient"])) < 1e-6
    # One stratum, most of it in one place.
    r, (x, _, zs) = fit_newton(df.where("k = 'hot'"), [], "z", ["a", "b"], "bernoulli", "logit").first(), data["hot"]
    assert r["coefficients"] == pytest.approx(list(dense_newton(x, zs, lambda e: 1 / (1 + np.exp(-e)), lambda m: m * (1 - m), np.zeros(3))), rel=1e-8)


def test_fits_of_odd_strata(spark):
    rows = [("flat", 2.0, 1.0)] * 5 + [("bad", -3.0, 1.0), ("bad", 2.0, 2.0), ("ok", 1.0, 0.0), ("ok", 4.0, 1.0), ("ok", 9.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, y double, x double")
    got = {r["k"]: r for r in fit_newton(df, ["k"], "y", ["x"], "poisson", "log").collect()}
    assert got["ok"]["converged"] and not got["flat"]["converged"] and not got["bad"]["converged"] and got["flat"]["coefficients"] is None and got["bad"]["log_likelihood"] is None
    only = {r["k"]: r for r in fit_newton(df.where("k <> 'bad'"), ["k"], "y", [], "negative_binomial", "log", fixed=2.0).collect()}
    assert only["flat"]["coefficients"] == pytest.approx([math.log(2)]) and only["ok"]["coefficients"] == pytest.approx([math.log(14 / 3)])
    trials = spark.createDataFrame([(3.0, 10.0), (5.0, 30.0)], "y double, t double")
    assert fit_newton(trials, [], "y", [], "binomial", "logit", fixed="t").first()["coefficients"] == pytest.approx([math.log(8 / 32)])
    assert fit_newton(df.limit(0), [], "y", ["x"], "poisson", "log").count() == 0 and fit_newton(df.limit(0), ["k"], "y", ["x"], "poisson", "log").count() == 0
    for family, link, fixed in (("poisson", "probit", None), ("normal", "identity", None), ("poisson", "log", 1.0)):
        with pytest.raises(Refused):
            fit_newton(df, [], "y", ["x"], family, link, fixed)
