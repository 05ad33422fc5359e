"""Incomplete gamma and its inverse, and compartments that must not fall below 0."""

import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from strataflow.functions import expr as X
from strataflow.functions.special import gamma_p, gamma_p_inverse, gamma_q
from strataflow.plans import simulate
from strataflow.plans.model import Model, Transition


def exact(n, x):
    """(P, Q) for a whole shape, by Poisson terms with many digits."""
    getcontext().prec = 80
    big = Decimal(x)
    term = total = Decimal(1)
    for k in range(1, n):
        term = term * big / k
        total += term
    q = (-big).exp() * total
    return float(1 - q), float(q)


def test_incomplete_gamma_to_twelve_digits(spark):
    rows = [(float(n), n * f) for n in (1, 3, 9, 10, 30, 300, 3000, 10_000) for f in (0.75, 0.9, 0.97, 1.0, 1.02, 1.1, 1.3)]
    rows += [(2.0, 200.0), (1.0, 1e-8), (5.0, 0.0), (5.0, math.inf), (1.0, 700.0)]
    for r in spark.createDataFrame(rows, "a double, x double").select("a", "x", gamma_p(F.col("a"), F.col("x")).alias("p"), gamma_q(F.col("a"), F.col("x")).alias("q")).collect():
        p, q = (1.0, 0.0) if r["x"] == math.inf else (0.0, 1.0) if r["x"] == 0 else exact(int(r["a"]), r["x"])
        for got, want in ((r["p"], p), (r["q"], q)):
            assert got == pytest.approx(want, rel=1e-12 if want > 1e-30 else 1e-6, abs=1e-60), r


def test_incomplete_gamma_at_broken_shapes(spark):
    # P(1/2, x) = erf(sqrt x), and P(a + 1, x) = P(a, x) - x^a exp(-x) / Gamma(a + 1).
    rows = [(x,) for x in (1e-6, 0.05, 0.5, 1.4, 1.6, 3.0, 30.0, 400.0)]
    a = F.lit(0.5)
    for r in spark.createDataFrame(rows, "x double").select("x", gamma_p(a, F.col("x")).alias("p"), gamma_q(a, F.col("x")).alias("q"), gamma_p(a + 1, F.col("x")).alias("up")).collect():
        x = r["x"]
        assert r["p"] == pytest.approx(math.erf(math.sqrt(x)), rel=1e-12) and r["q"] == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-11, abs=1e-300)
        assert r["up"] == pytest.approx(r["p"] - math.sqrt(x) * math.exp(-x) / math.gamma(1.5), rel=1e-9, abs=1e-15)


def test_inverse_incomplete_gamma(spark):
    rows = [(a, p) for a in (0.1, 0.355, 1.0, 2.0, 5.0, 10.0, 100.0, 1e4) for p in (1e-12, 0.01, 0.25, 0.5, 0.75, 0.99, 1 - 1e-9)]
    df = spark.createDataFrame(rows, "a double, p double").withColumn("x", gamma_p_inverse(F.col("a"), F.col("p")))
    for r in df.select("a", "p", "x", gamma_p(F.col("a"), F.col("x")).alias("back"), gamma_q(F.col("a"), F.col("x")).alias("rest")).collect():
        assert r["x"] > 0
        got, want = (r["back"], r["p"]) if r["p"] < 0.5 else (r["rest"], 1 - r["p"])
        assert got == pytest.approx(want, rel=3e-12), r
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(gamma_p_inverse(F.lit(2.0), F.col("p"))).collect()
    assert [r[0] for r in ends] == [0.0, math.inf]


def drained(real, outflow, dt=1.0, every=1):
    return Model(("V",), ("o",), (Transition("out", "V", None, outflow),), initial={"V": X.lift(1)}, real=real), dt, every


def test_real_compartments_stop_at_zero(spark):
    cell = spark.createDataFrame([(5.0,)], "o double")
    m, dt, every = drained(("V",), X.ref("o"))
    path = simulate.ode(cell, m, 0.0, 2.0, dt).orderBy("time").collect()
    assert [(r["time"], r["V"]) for r in path] == [(0.0, 1.0), (1.0, 0.0), (2.0, 0.0)]
    # A stiff decay is stable because steps are cut.
    m, dt, every = drained(("V",), X.ref("o") * X.ref("V"))
    end = simulate.ode(spark.createDataFrame([(2.0,)], "o double"), m, 0.0, 8.0, 4.0).where("time = 8").first()["V"]
    assert end == pytest.approx(0.375**16)


def test_other_compartments_below_zero_are_refused(spark):
    m, dt, _ = drained((), X.ref("o"))
    with pytest.raises(Exception, match="fell below 0"):
        simulate.ode(spark.createDataFrame([(5.0,)], "o double"), m, 0.0, 2.0, dt).collect()


def test_the_end_is_an_output(spark):
    m, _, _ = drained(("V",), X.ref("o") * X.ref("V"))
    path = simulate.ode(spark.createDataFrame([(0.1,)], "o double"), m, 0.0, 1.0, 0.3, every=3).orderBy("time").collect()
    assert [round(r["time"], 6) for r in path] == [0.0, 0.9, 1.0] and round(path[-1]["t_start"], 6) == 0.9
    assert sum(r["flow_out"] for r in path) == pytest.approx(1 - path[-1]["V"])
