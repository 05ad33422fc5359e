"""Simulation, fitting, files and streams."""

import math

import pytest
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions import expr as X
from strataflow.plans import grid, infer, model, simulate
from strataflow.queries.dynamics import WEEKLY, sir
from strataflow.sources import sinks, tables
from strataflow.streaming import streams


def cells(spark, n=1, beta=0.6):
    points = grid.sweep(spark, {"beta": [beta], "gamma": [0.2]}).withColumns({"N": F.lit(10000.0), "rho": F.lit(0.5)})
    return grid.run_grid(spark.createDataFrame([("base",), ("other",)], "scenario string"), points, n, 7)


def test_final_size(spark):
    """At R0 = 3 the final size solves z = 1 - s0 exp(-3 z)."""
    end = simulate.ode(cells(spark), sir(), 0.0, 300.0, 0.5, every=600).where("time = 300").first()
    z = end["R"] / 10000
    assert abs(z - (1 - 0.999 * math.exp(-3 * z))) < 1e-4 and abs(z - 0.9405) < 0.002
    assert abs(end["S"] + end["I"] + end["R"] - 10000) < 1e-6 and abs(end["flow_infection"] - (9990 - end["S"])) < 1e-6


def test_stochastic_runs_conserve_and_ignore_partitions(spark):
    one = simulate.chain_binomial(cells(spark, 3), sir(), 0.0, 60.0, 0.5, every=10)
    other = simulate.chain_binomial(cells(spark, 3), sir(), 0.0, 60.0, 0.5, every=10, partitions=3)
    assert one.where("S + I + R <> 10000").count() == 0
    assert one.exceptAll(other).count() == 0
    arms = one.groupBy("replicate", "time").agg(F.countDistinct("S").alias("n")).where("n > 1")
    assert arms.count() == 0  # scenarios share random numbers


def test_event_driven_conserves(spark):
    assert simulate.gillespie(cells(spark), sir(), 0.0, 20.0, 5.0).where("S + I + R <> 10000").count() == 0


def test_actions_and_flows(spark):
    s = X.ref("S")
    m = model.Model(("S", "V"), ("r",), (model.Transition("out", "S", "V", X.ref("r") * s),), initial={"S": X.lift(100)}, actions=(model.Action("move", "fraction", (5.0,), 0.5, "S", "V"),))
    row = spark.createDataFrame([(0.0, 1, 1)], "r double, seed long, cell long")
    path = simulate.ode(row, m, 0.0, 10.0, 1.0).orderBy("time").collect()
    # An effect comes before the output of the same time.
    assert [r["S"] for r in path][4:7] == [100, 50, 50]
    assert [r["S"] for r in simulate.chain_binomial(row, m, 0.0, 10.0, 1.0).orderBy("time").collect()][4:7] == [100, 50, 50]


def test_capabilities_and_problems():
    m = model.Model(("A",), (), (model.Transition("x", "A", None, X.ref("zz"), overdispersion=0.1),))
    assert model.problems(m) == ["x: unknown name zz"]
    with pytest.raises(Refused):
        model.refuse_unsupported(m, "gillespie")
    with pytest.raises(Refused):
        model.method("mh", "chain_binomial")
    assert model.largest_remainder(10, [1, 1, 1]) == [4, 3, 3]
    assert model.initial_order(model.Model(("A", "B"), (), (), initial={"A": X.ref("B") * 2, "B": X.lift(1)})) == ["B", "A"]


def test_stages_keep_the_mean_stay(spark):
    m = model.Model(("I", "R"), ("g",), (model.Transition("rec", "I", "R", X.ref("g") * X.ref("I")),), initial={"I": X.lift(1000)})
    three = model.staged(m, "I", 3, "rec")
    row = spark.createDataFrame([(0.2,)], "g double")
    path = simulate.ode(row, three, 0.0, 60.0, 0.1, every=1).select("time", (F.col("I_1") + F.col("I_2") + F.col("I_3")).alias("i"))
    mean = path.agg(F.sum(F.col("i") * 0.1).alias("m")).first()["m"] / 1000
    assert abs(mean - 5) < 0.1


def test_filter_agrees_with_exact_likelihood_of_pure_death(spark):
    """With one step per observation the filter's likelihood is a binomial mixture that can be summed exactly."""
    m = model.Model(("A", "D"), ("p", "rho"), (model.Transition("die", "A", "D", X.ref("p") * X.ref("A")),), initial={"A": X.lift(20)})
    f = infer.Filter(m, [(1.0, 4.0)], "die", 0.0, 1.0, "rho")
    q = 1 - math.exp(-0.3)
    exact = math.log(sum(math.comb(20, k) * q**k * (1 - q) ** (20 - k) * math.exp(-0.8 * k) * (0.8 * k) ** 4 / 24 for k in range(1, 21)))
    points = spark.createDataFrame([(0.3, 0.8, s) for s in range(4)], "p double, rho double, seed long")
    for r in infer.loglik_grid(points, f, 20_000).collect():
        assert abs(r["loglik"] - exact) < 0.05


def test_fits_recover_beta(spark):
    ll = infer.ode_loglik(sir(), WEEKLY, "infection", 0.0, 0.5, "rho")
    starts = infer.starts_within(spark, {"beta": (0.25, 0.65)}, {"gamma": 0.2, "N": 10000.0, "rho": 0.5}, 2, 1)
    best = infer.nelder_mead(starts, sir(), {"beta": (0.2, 0.7)}, ll, 80).collect()
    assert max(r["beta"] for r in best) - min(r["beta"] for r in best) < 1e-3


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.0, 5, None), (0, 0, 2.0, 7, 3)], "chain long, draw long, time double, S long, parent_id long")
    at = f"file://{tmp_path}/paths"
    sinks.write_trajectories(df, at, {"model": "m"})
    assert sinks.get_json(spark, at + ".manifest.json")["columns"] == df.columns
    with pytest.raises(Refused):
        sinks.write_trajectories(df.drop("S"), at, {}, append=True)
    made = []
    for _ in range(2):
        got = sinks.content_leaf(spark, f"file://{tmp_path}/store", "sim", {"a": 1}, lambda: (made.append(1), df)[1])
    assert got.count() == 2 and made == [1]
    (tmp_path / "t.tsv").write_text("k\tv\na\t1.5\nb\tNA\n")
    assert [r["v"] for r in tables.read_keyed(spark, f"{tmp_path}/t.tsv", ["k"], ["v"]).orderBy("k").collect()] == [1.5, None]
    with pytest.raises(Refused):
        tables.time_axis(spark.createDataFrame([("1",), ("2020-01-01",)], "t string"), "t", "2020-01-01")


def test_stream_of_sojourns_and_triggers(spark, tmp_path):
    spark.createDataFrame([(7, 1.0, 1), (7, 3.0, -1), (7, 5.0, 1), (8, 2.0, -1)], "individual long, time double, kind int").write.parquet(f"{tmp_path}/e")
    rows = spark.readStream.schema("individual long, time double, kind int").parquet(f"{tmp_path}/e")
    q = streams.sojourn_stream(rows).writeStream.format("memory").queryName("stays").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["individual"], r["dwell"]) for r in spark.table("stays").collect()] == [(7, 2.0)]
    spark.createDataFrame([("a", float(t), v) for t, v in enumerate([1.0, 5.0, 6.0, 0.0, 20.0])], "stratum string, time double, value double").coalesce(1).write.parquet(f"{tmp_path}/o")
    rows = spark.readStream.schema("stratum string, time double, value double").parquet(f"{tmp_path}/o")
    q = streams.trigger_stream(rows, 2.0, 10.0, cooldown=2.0, delay=1.0).writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["fired_at"], r["due_at"]) for r in spark.table("fired").collect()) == [(2.0, 3.0), (4.0, 5.0)]
