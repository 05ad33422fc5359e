"""Hand-checked small cases, refusals and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions import arithmetic, calendar, density, expr, forcing, special
from strataflow.operators import bands, catalog, diagnostics, joins, lineage, reduce, scores, windows
from strataflow.plans import grid
from strataflow.sources import sinks


def series(spark, values, times=None):
    return spark.createDataFrame([("a", float(t), v) for t, v in zip(times or range(len(values)), values, strict=True)], "k string, t double, v double")


def one(df):
    return df.collect()[0].asDict()


def test_reduce_basic(spark):
    r = one(reduce.reductions(series(spark, [1.0, 5.0, 5.0, 2.0], [0, 1, 3, 4]), ["k"], "t", "v", 4.0))
    assert r == {"k": "a", "final": 2, "max": 5, "min": 1, "mean": 3.25, "time_of_max": 1, "time_of_min": 0, "integral": 16.5, "count_above": 2, "first_above": 1, "last_above": 3, "count_below": 2, "first_below": 0, "last_below": 4}


def test_reduce_not_finite(spark):
    nan = float("nan")
    r = one(reduce.reductions(series(spark, [nan, 2.0, nan]), ["k"], "t", "v", 1.0))
    assert (r["max"], r["min"], r["count_above"]) == (2, 2, 1) and math.isnan(r["mean"])


def test_crossing_that_never_happens_is_missing(spark):
    r = reduce.reductions(series(spark, [1.0, 2.0]), ["k"], "t", "v", 9.0).withColumn("gap", F.col("last_above") - F.col("first_above"))
    assert one(r)["gap"] is None


@pytest.mark.parametrize(("at", "value"), [(10, 8), (19.9, 8), (20, 9), (25, None), (-1, None)])
def test_value_at(spark, at, value):
    s = series(spark, [7.0, 8.0, 9.0], [0, 10, 20])
    assert one(reduce.value_at(s, ["k"], "t", "v", at))["value_at"] == value
    points = spark.createDataFrame([("a", float(at))], "k string, at double")
    assert one(joins.as_of(points, s, ["k"], "at", "t", "v"))["v"] == value


def test_empty_tables(spark):
    none = series(spark, [])
    assert reduce.reductions(none, ["k"], "t", "v", 1.0).count() == 0
    assert bands.band(none, ["k"], "v").count() == 0
    assert windows.cohort_bins(none, ["k"], "t", 1.0).count() == 0
    assert diagnostics.newey_west(none, ["k"], "t", "v").count() == 0


def test_quantiles(spark):
    b = one(bands.band(series(spark, [1.0, 2.0, 3.0, 4.0]), ["k"], "v"))
    assert (b["q25"], b["q50"]) == (1.75, 2.5) and abs(b["q95"] - 3.85) < 1e-12
    n = one(bands.nearest_rank(series(spark, [1.0, 2.0, 3.0, 4.0]), ["k"], "v", (0.25, 0.5, 0.51)))
    assert (n["q25"], n["q50"], n["q51"]) == (1, 2, 3)


def test_band_refuses_nan(spark):
    with pytest.raises(Refused):
        bands.band(series(spark, [1.0, float("nan")]), ["k"], "v")


def test_weighted_quantiles_drop_weightless(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 1.0), (1, 3.0, 3.0)], "g int, x double, w double")
    r = one(bands.weighted_quantiles(df, ["g"], "x", "w", (0.25, 0.5)))
    assert (r["mean"], r["q25"], r["q50"]) == (2.75, 2, 3)


def test_log_mean_exp_edges(spark):
    inf = float("-inf")
    df = spark.createDataFrame([("a", 0.0), ("b", inf), ("b", inf), ("c", -1000.0), ("c", -1000.0)], "g string, x double")
    r = {x["g"]: x for x in bands.log_mean_exp(df, ["g"], "x").collect()}
    assert r["a"]["log_mean"] == 0 and r["a"]["log_mean_se"] == 0
    assert r["b"]["log_mean"] == inf and math.isnan(r["b"]["log_mean_se"])
    assert r["c"]["log_mean"] == -1000


@pytest.mark.parametrize(("form", "bounds"), [("day", (11, 12)), ("starting_on", (11, 18)), ("ending_on", (5, 12)), ("closing_at", (4, 11))])
def test_window_forms(spark, form, bounds):
    w = one(windows.label_window(spark.createDataFrame([(11.0,)], "t double"), "t", form, 7.0))
    assert (w["start"], w["stop"]) == bounds


def test_trailing_is_open_at_the_low_edge(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 5.0), ("a", 8, 6.0)], "k string, t long, v double")
    last = [r for r in windows.trailing(df, ["k"], "t", 6, "v").collect() if r["t"] == 8][0]
    assert (last["w_sum"], last["w_mean"], last["w_max"], last["w_latest"]) == (6, 6, 6, 6)


def test_cohorts(spark):
    out = windows.cohort_bins(series(spark, [0.0] * 3, [0.5, 1, 2.4]), ["k"], "t", 1.0).orderBy("bin").collect()
    assert [(r["lo"], r["n"], r["cumulative"]) for r in out] == [(0.5, 2, 2), (1.5, 1, 3)]


def test_gap_is_refused_only_for_uniform_windows(spark):
    w = spark.createDataFrame([("a", 7, 8), ("a", 8, 9), ("a", 10, 11), ("a", 10, 12)], "k string, start int, stop int")
    assert sorted(r["violation"] for r in windows.window_violations(w, ["k"], uniform=True).collect()) == ["gap", "overlap"]
    assert [r["violation"] for r in windows.window_violations(w, ["k"]).collect()] == ["overlap"]


def test_sojourns(spark):
    df = spark.createDataFrame([(7, 1, 1), (7, 3, -1), (7, 5, 1), (8, 2, -1)], "i int, t int, k int")
    out = lineage.sojourns(df, "i", "t", F.col("k")).orderBy("in_time").collect()
    assert [(r["i"], r["dwell"], r["censored"]) for r in out] == [(7, 2, False), (7, None, True)]


@pytest.mark.parametrize(("n", "lag"), [(50, 3), (100, 4), (200, 4)])
def test_newey_west_lag(spark, n, lag):
    assert one(diagnostics.newey_west(series(spark, [float(i % 7) for i in range(n)]), ["k"], "t", "v"))["nw_lag"] == lag


def test_newey_west_against_definition(spark):
    x = [math.sin(i) + i % 3 for i in range(120)]
    c = [v - sum(x) / 120 for v in x]
    var = sum(v * v for v in c) + sum(2 * (1 - k / 5) * sum(a * b for a, b in zip(c, c[k:], strict=False)) for k in range(1, 5))
    assert abs(one(diagnostics.newey_west(series(spark, x), ["k"], "t", "v"))["nw_se"] - math.sqrt(var)) < 1e-9


def test_crps_and_pit(spark):
    assert one(scores.fair_crps(spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0)], "k string, x double, y double"), ["k"], "x", "y"))["crps"] == 0
    df = spark.createDataFrame([("a", x, 2.0) for x in (1.0, 2.0, 2.0, 5.0)], "k string, x double, y double")
    assert one(scores.randomised_pit(df, ["k"], "x", "y", F.lit(0.5)))["pit"] == 0.5


def test_sweep_order(spark):
    got = [(r["alpha"], r["beta"]) for r in grid.sweep(spark, {"beta": [0.2, 0.3], "alpha": [1, 2]}).orderBy("point_id").collect()]
    assert got == [(1, 0.2), (1, 0.3), (2, 0.2), (2, 0.3)]
    assert [round(x, 12) for x in grid.axis("log10(0.1,10,3)")] == [0.1, 1, 10]
    assert grid.seeds("3:5") == [3, 4, 5]


def test_calendar(spark):
    d = spark.createDataFrame([("2020-01-31",)], "d string").select(F.col("d").cast("date").alias("d"))
    r = d.select(calendar.add_months(F.col("d"), 1).cast("string").alias("a"), F.size(calendar.date_range(F.col("d"), count=3, months=1)).alias("n"), calendar.parse_iso(F.lit("2020-02-01.5"), "2020-01-31").alias("t"), calendar.parse_iso(F.lit("2020-02-01Z"), "2020-01-31").alias("z"))
    assert tuple(one(r).values()) == ("2020-02-29", 4, 1.5, None)


def test_arithmetic_modes(spark):
    df = spark.range(1)
    assert one(df.select(arithmetic.modulo(F.lit(-1.5), F.lit(7.0)).alias("x")))["x"] == 5.5
    r = one(df.select(arithmetic.divide(F.lit(0.0), F.lit(0.0), "ieee").alias("a"), arithmetic.divide(F.lit(-1.0), F.lit(0.0), "ieee").alias("b"), arithmetic.divide(F.lit(1.0), F.lit(0.0), "null").alias("c")))
    assert math.isnan(r["a"]) and r["b"] == float("-inf") and r["c"] is None
    with pytest.raises(Exception, match="division by zero"):
        spark.range(1).select(arithmetic.divide(F.col("id"), F.col("id") * 0)).collect()


def test_forcings(spark):
    t = spark.createDataFrame([(x,) for x in (9.0, 10.0, 20.0, -1.0)], "t double")
    r = t.select(forcing.piecewise(F.col("t"), [10, 20], [1, 2, 3]).alias("p"), forcing.periodic(F.col("t"), 4.0, [5, 6]).alias("q")).collect()
    assert [x["p"] for x in r] == [1, 2, 3, 1] and r[3]["q"] == 6
    with pytest.raises(ValueError, match="increase"):
        forcing.natural_spline(F.col("t"), [0, 0, 1], [1, 2, 3])


def test_splines_reproduce_lines_and_partition_unity(spark):
    t = spark.createDataFrame([(x / 7,) for x in range(50)], "t double")
    c = F.col("t")
    got = t.select("t", forcing.natural_spline(c, [0, 2, 5, 9], [1, 5, 11, 19]).alias("n"), forcing.b_spline(c, [0, 3, 8], 3, [1.0] * 5).alias("b"), forcing.periodic_b_spline(c, 2.5, [1.0] * 6).alias("p")).collect()
    for r in got:
        assert abs(r["n"] - (1 + 2 * r["t"])) < 1e-9 and abs(r["b"] - 1) < 1e-9 and abs(r["p"] - 1) < 1e-9


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 171.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    for r in df.select("x", special.lgamma(F.col("x")).alias("g"), special.normal_cdf(F.col("x")).alias("c"), special.normal_quantile(F.lit(0.975)).alias("q")).collect():
        assert abs(r["g"] - math.lgamma(r["x"])) < 1e-9 * max(1, abs(r["g"]))
        assert abs(r["c"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 2e-7 and abs(r["q"] - 1.959964) < 1e-5


def test_densities_sum_to_one_and_edges(spark):
    y = spark.range(400).select(F.col("id").cast("double").alias("y"))
    s = y.agg(F.sum(F.exp(density.poisson(F.col("y"), F.lit(20.0)))).alias("p"), F.sum(F.exp(density.negative_binomial(F.col("y"), F.lit(20.0), F.lit(3.0)))).alias("n"), F.sum(F.exp(density.binomial(F.col("y"), F.lit(30.0), F.lit(0.3)))).alias("b"), F.sum(F.exp(density.beta_binomial(F.col("y"), F.lit(30.0), F.lit(2.0), F.lit(3.0)))).alias("bb"))
    assert all(abs(v - 1) < 1e-7 for v in one(s).values())
    nan = F.lit(float("nan"))
    e = one(spark.range(1).select(density.poisson(F.lit(0.0), F.lit(0.0)).alias("a"), density.poisson(F.lit(1.0), F.lit(0.0)).alias("b"), density.poisson(nan, F.lit(1.0)).alias("c"), density.binomial(F.lit(0.0), F.lit(0.0), F.lit(0.5)).alias("d"), density.binomial(F.lit(3.0), F.lit(2.0), F.lit(0.5)).alias("e"), density.zero_inflated_negative_binomial(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.3)).alias("f")))
    low = float("-inf")
    assert tuple(e.values()) == (0, low, low, 0, low, low)


def test_expression_passes():
    a, b = expr.ref("a"), expr.ref("b")
    assert expr.simplify(a * 0 + b * 1 + 0) == b
    assert expr.validate(a + expr.ref("zz"), {"a"}) == ["unknown name zz"]
    d = expr.simplify(expr.differentiate(expr.call("exp", a * 2), "a"))
    assert d == expr.call("exp", a * 2) * 2
    with pytest.raises(ValueError, match="mixes"):
        expr.dimension(a + b, {"a": expr.Dim(1, 0), "b": expr.Dim(0, 1)})
    assert expr.dimension(a / b, {"a": expr.Dim(1, 0), "b": expr.Dim(0, 1)}) == expr.Dim(1, -1)
    assert set(expr.invariants(a * 2 + b, {"a"}).values()) == {a * 2}


def test_refusals(spark):
    runs = spark.createDataFrame([("abc1", 1), ("abc2", 2)], "run_id string, x int")
    with pytest.raises(Refused):
        catalog.resolve_prefix(runs, "abc")
    assert catalog.resolve_prefix(runs, "abc1") == "abc1"
    cells = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Refused):
        joins.with_default(cells, spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v")
    with pytest.raises(Refused):
        joins.select_chains(spark.createDataFrame([(0,)], "chain int"), keep=[0], drop=[1])


def test_ess_of_independent_and_sticky_chains(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 500))
    sticky = np.zeros((4, 500))
    for i in range(1, 500):
        sticky[:, i] = 0.9 * sticky[:, i - 1] + rng.normal(size=4)
    assert 1500 < diagnostics.ess_of(x) < 2600
    assert 40 < diagnostics.ess_of(sticky) < 250
    rows = [("n", c, i, float(x[c, i])) for c in range(4) for i in range(500)] + [("far", c, i, float(x[c, i] + 3 * c)) for c in range(4) for i in range(500)]
    r = {r["p"]: r for r in diagnostics.rank_rhat(spark.createDataFrame(rows, "p string, chain int, draw int, v double"), ["p"], "chain", "draw", "v").collect()}
    assert r["n"]["rhat"] < 1.02 and r["far"]["rhat"] > 1.5


def test_newick(spark):
    edges = spark.createDataFrame([(1, None, 0.0), (2, 1, 1.0), (3, 1, 2.0), (4, 2, 3.5)], "child long, parent long, time double")
    assert one(lineage.newick(edges, lineage.with_root(edges)))["newick"] == "((4:2.5)2:1,3:2)1;"


def test_more_chains_prefixes_and_rows_than_old_bounds(spark):
    chains = spark.range(12_000).selectExpr("CAST(id AS INT) AS chain", "id AS x")
    assert joins.select_chains(chains, drop=[3]).count() == 11_999
    assert joins.select_chains(chains.unionByName(spark.createDataFrame([(None, 5)], "chain int, x long")), drop=[3]).count() == 12_000
    assert [r["chain"] for r in joins.select_chains(chains, keep=[11_999]).collect()] == [11_999]
    with pytest.raises(Refused):
        joins.select_chains(chains, keep=[12_000])
    name = "a" * 150
    prefixes = spark.createDataFrame([(name[:n],) for n in range(1, 151)] + [(name + "b",)], "prefix string")
    got = catalog.prefix_matches(spark.createDataFrame([(name,)], "run_id string"), prefixes).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"resolved": 150, "unknown": 1}
    with pytest.raises(Refused):
        catalog.render(spark.range(11), rows=10)
    assert len(catalog.render(spark.range(10), "csv", rows=10).split()) == 11


def test_newey_west_takes_every_lag(spark):
    # At 1,330,586 rows the lag passes 32; a series that repeats every 34 steps has products there.
    n = 1_400_000
    out = diagnostics.newey_west(spark.range(n).selectExpr("1 AS k", "id AS t", "CAST(IF(id % 34 = 0, 33.0, -1.0) AS DOUBLE) AS v"), ["k"], "t", "v").first()
    lag = int(4 * (n / 100) ** (2 / 9))
    assert out["nw_lag"] == lag == 33

    import numpy as np

    v = np.where(np.arange(n) % 34 == 0, 33.0, -1.0)
    c = v - v.mean()
    var = (c * c).sum() + sum(2 * (1 - k / (lag + 1)) * (c[k:] * c[:-k]).sum() for k in range(1, lag + 1))
    assert abs(out["nw_se"] - np.sqrt(max(var, 0.0))) < 1e-6 * np.sqrt((c * c).sum())


def test_leaves_are_claimed_by_one_writer(spark, tmp_path):
    root, df = f"file://{tmp_path}/store", spark.range(3)

    def inner():
        with pytest.raises(Refused):
            sinks.content_leaf(spark, root, "sim", {"a": 1}, lambda: df)
        return df

    assert sinks.content_leaf(spark, root, "sim", {"a": 1}, inner).count() == 3
    with pytest.raises(ZeroDivisionError):
        sinks.content_leaf(spark, root, "sim", {"a": 2}, lambda: 1 / 0)
    # A failed run gives its claim up; one that died leaves it, and another may take over.
    leaf = f"{tmp_path}/store/kind=sim/{sinks.content_id({'a': 2})}"
    assert sinks.leaf_state(spark, f"file://{leaf}") == "free"
    (tmp_path / "store" / "kind=sim" / sinks.content_id({"a": 2}) / "claim").touch()
    with pytest.raises(Refused):
        sinks.content_leaf(spark, root, "sim", {"a": 2}, lambda: df)
    assert sinks.content_leaf(spark, root, "sim", {"a": 2}, lambda: df, take_over=True).count() == 3


def test_normal_tails_keep_their_digits(spark):
    from statistics import NormalDist

    xs = [-9.0, -7.2, -3.3, -0.4, 0.0, 0.7, 2.5, 6.9, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.normal_cdf(F.col("x")).alias("p"), special.normal_mass(F.col("x"), F.col("x") + 1).alias("m")).collect()
    for r in got:
        assert abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-14 + 1e-12 * r["p"]
        exact = 0.5 * (math.erfc(r["x"] / math.sqrt(2)) - math.erfc((r["x"] + 1) / math.sqrt(2)))
        assert abs(r["m"] - exact) <= 1e-9 * exact if r["x"] > 0 else abs(r["m"] - exact) < 1e-12
