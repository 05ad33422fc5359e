"""Lag products over blocks with halos against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import diagnostics, latent
from strataflow.operators.lags import centred, lag_products


@pytest.mark.parametrize(("block", "lags"), [(4096, 5), (7, 5), (3, 5), (1, 3)])
def test_lag_products_equal_loops(spark, block, lags):
    rng = random.Random(block)
    series = {None: 1, "a": 40, "b": 3, "hot": 300}
    rows = [(k, i * 2, rng.gauss(0, 1)) for k, n in series.items() for i in range(n)]
    rng.shuffle(rows)
    got = {r["k"]: r for r in lag_products(centred(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v"), ["k"], "v", lags, block).collect()}
    assert set(got) == set(series)
    for k, n in series.items():
        v = [x for _, x in sorted((t, v) for q, t, v in rows if q == k)]
        d = [x - sum(v) / n for x in v]
        assert got[k]["n"] == n and got[k]["total"] == pytest.approx(sum(v))
        for j in range(lags + 1):
            want = sum(d[i] * d[i - j] for i in range(j, n)) if n > j else None
            assert got[k][f"g{j}"] == pytest.approx(want, abs=1e-9) if want is not None else got[k][f"g{j}"] is None


def test_null_values_leave_their_products_out(spark):
    rows = [("k", i, None if i == 2 else float(i)) for i in range(6)]
    (r,) = lag_products(centred(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v"), ["k"], "v", 1, 2).collect()
    d = [None if i == 2 else i - 13 / 5 for i in range(6)]
    assert r["n"] == 6 and r["g1"] == pytest.approx(sum(a * b for a, b in zip(d, d[1:], strict=False) if a is not None and b is not None))


def test_one_long_series_is_spread(spark):
    df = spark.range(60_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.rand(3).alias("v"))
    out = diagnostics.newey_west(df, ["k"], "t", "v").first()
    assert out["n"] == 60_000 and abs(out["lag1"]) < 0.02
    assert latent.chain_length_ess(df, ["k"], "t", "v").first()["ess"] > 40_000
