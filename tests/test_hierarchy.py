"""Priors whose arguments come from the level above."""

import math

import pytest
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions.density import prior, prior_given
from strataflow.operators.hierarchy import level_log_prior


def test_columns_give_what_numbers_give(spark):
    cases = {"normal": (0.3, 2.0), "half_normal": (1.5,), "log_normal": (0.1, 0.7), "exponential": (1.5,), "gamma": (2.5, 0.8)}
    x = spark.createDataFrame([(-1.0,), (0.0,), (0.4,), (7.0,)], "x double")
    pairs = [c.alias(f"{f}{k}") for f, a in cases.items() for k, c in enumerate((prior(F.col("x"), f, *a), prior_given(F.col("x"), f, *map(F.lit, a))))]
    for r in x.select(*pairs).collect():
        for f in cases:
            assert r[f + "1"] == pytest.approx(r[f + "0"], abs=1e-9), f


def test_sums_by_unit_above(spark):
    above = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, -1.0), ("c", 0.0, 1.0), ("d", None, 1.0)], "k string, mu double, sd double")
    units = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("d", 1.0)], "k string, x double")
    got = {r["k"]: (r["units"], r["log_prior"]) for r in level_log_prior(units, above, "k", "x", "normal", ["mu", "sd"]).collect()}
    assert got["a"] == (2, pytest.approx(-0.5 - 2 * math.log(2) - math.log(2 * math.pi))) and got["b"] == (1, -math.inf) and got["c"] == (0, 0.0) and got["d"] == (1, None)
    for bad, table in ((units.union(units.selectExpr("'z'", "x")), above), (units, above.union(above))):
        with pytest.raises(Refused):
            level_log_prior(bad, table, "k", "x", "normal", ["mu", "sd"])
