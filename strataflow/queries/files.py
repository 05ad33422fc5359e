"""Readers and writers: what is written to the shared folder and read back must be what SQL says of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataflow.operators.scratch import folder
from strataflow.plans import simulate
from strataflow.plans.model import Model, Transition
from strataflow.queries import query
from strataflow.queries.base import DAILY, EVENTS, daily, events, rounded, table
from strataflow.functions import expr as X
from strataflow.sources import sinks, tables


def fresh(spark, name: str) -> str:
    return f"{folder(spark)}/strataflow-files-{uuid.uuid4().hex[:12]}/{name}"


@query("keyed_table_file", f"WITH {DAILY} SELECT event_type, CAST(day AS VARCHAR) AS day, CAST(CASE WHEN n > 20 THEN n END AS DOUBLE) AS n, v FROM daily")
def keyed_table_file(spark, sf_dir):
    """A long table as TSV: keys are text, values numbers, missing ones NA; columns bind by name."""
    path = fresh(spark, "daily.tsv")
    d = daily(spark, sf_dir).select("v", "event_type", F.when(F.col("n") > 20, F.col("n")).alias("n"), "day")
    sinks.write_table(d, path, "tsv")
    return tables.read_keyed(spark, path, ["event_type", "day"], ["n", "v"])


@query("bound_cells", f"WITH {DAILY} SELECT event_type, day, CAST(n AS DOUBLE) AS n, v FROM daily")
def bound_cells(spark, sf_dir):
    """Two values of one table, each bound to exactly one number per cell."""
    d = daily(spark, sf_dir)
    cells = d.select("event_type", "day").distinct()
    keys = ["event_type", "day"]
    parts = {k: tables.bind_cells(cells, t.withColumnRenamed("value", k), keys, k) for k, t in tables.split_values(d, keys, ["n", "v"]).items()}
    return parts["n"].join(parts["v"], keys)


@query("series_of_a_stratum", f"WITH {DAILY} SELECT CAST(day AS DOUBLE) AS time, round(v * 0.001, 6) AS value FROM daily WHERE event_type = 'click'")
def series_of_a_stratum(spark, sf_dir):
    return rounded(tables.read_series(daily(spark, sf_dir), "day", "v", "event_type", "click", 0.001))


@query("streams_from_wide_rows", "SELECT o_orderkey, 'price' AS stream, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'day', CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) FROM orders")
def streams_from_wide_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"))
    return tables.wide_to_long(o, "o_orderkey", ["price", "day"])


@query("routed_rows", "SELECT c_custkey, c_nationkey, n_name AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey")
def routed_rows(spark, sf_dir):
    strata = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("stratum"))
    return tables.route(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), strata, ["c_nationkey"])


@query("dated_axis", "SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 7.0 AS DOUBLE) AS t FROM orders")
def dated_axis(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return tables.time_axis(o, "at", "1992-01-01", "weeks").select("o_orderkey", "t")


@query("numbered_design_points", "SELECT row_number() OVER (ORDER BY p_retailprice, p_size, p_partkey) - 1 AS point_id, p_retailprice, CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS DOUBLE) AS p_partkey FROM part")
def numbered_design_points(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_retailprice", "p_size", "p_partkey")
    return tables.sweep_points(p, ["p_retailprice", "p_size", "p_partkey"])


PATHS = f"{DAILY}, paths AS (SELECT row_number() OVER (PARTITION BY day ORDER BY event_type) - 1 AS chain, 0 AS draw, CAST(day AS DOUBLE) AS time, CAST(n AS DOUBLE) AS n, v FROM daily)"


def _paths(spark, sf_dir):
    from pyspark.sql.window import Window as W

    chain = (F.row_number().over(W.partitionBy("day").orderBy("event_type")) - 1).cast("long")
    return daily(spark, sf_dir).select(chain.alias("chain"), F.lit(0).cast("long").alias("draw"), F.col("day").cast("double").alias("time"), F.col("n").cast("double").alias("n"), "v")


@query("trajectory_files", f"WITH {PATHS} SELECT chain, draw, time, n, v FROM paths")
def trajectory_files(spark, sf_dir):
    """Written in two parts, the second appended under the manifest of the first."""
    path, p = fresh(spark, "paths"), _paths(spark, sf_dir)
    sinks.write_trajectories(p.where("chain = 0"), path, {"dt": 1.0})
    sinks.write_trajectories(p.where("chain > 0"), path, {"dt": 1.0}, append=True)
    return spark.read.parquet(path).select(*sinks.get_json(spark, f"{path}.manifest.json")["columns"])


@query("final_state_files", f"WITH {PATHS} SELECT chain, draw, max(time) AS time, arg_max(n, time) AS n, arg_max(v, time) AS v FROM paths GROUP BY chain, draw")
def final_state_files(spark, sf_dir):
    path = fresh(spark, "final")
    sinks.write_final_states(_paths(spark, sf_dir), path, ["n", "v"])
    return tables.read_final_states(spark, path, ["n", "v"])


@query("one_path_and_its_times", f"WITH {PATHS} SELECT time, n FROM paths WHERE chain = 1 AND draw = 0 AND time IN (SELECT time FROM paths WHERE chain = 0)")
def one_path_and_its_times(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return tables.one_path(p, 1, 0).join(tables.snapshot_times(p, 0, 0), "time").select("time", "n")


@query("draws_of_completed_runs", "SELECT o_custkey AS run_id, l_linenumber AS draw, l_tax AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def draws_of_completed_runs(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    draws = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("run_id"), F.col("l_linenumber").alias("draw"), F.col("l_tax").alias("x"))
    first = o.agg(F.min("o_custkey")).first()[0]
    runs = o.select(F.col("o_custkey").alias("run_id"), F.lit("completed").alias("status")).distinct()
    return tables.completed_draws(draws, runs, first)


@query("joint_draws", f"WITH {PATHS} SELECT chain, draw, time, v, CAST(chain + 0.5 AS DOUBLE) AS beta FROM paths")
def joint_draws(spark, sf_dir):
    p = _paths(spark, sf_dir)
    parameters = p.select("chain", "draw").distinct().withColumn("beta", (F.col("chain") + 0.5).cast("double"))
    return tables.joint_draws(parameters, p).select("chain", "draw", "time", "v", "beta")


def _inflow() -> Model:
    return Model(("A", "B"), ("r",), (Transition("inflow", None, "A", X.ref("r"), law="deterministic"), Transition("moved", "A", "B", X.ref("A") * X.lift(0.5), law="deterministic")), initial={"A": X.lift(0), "B": X.lift(0)})


@query(
    "event_log_files",
    """WITH RECURSIVE c AS (SELECT c_custkey AS k, 1.0 + c_custkey % 7 AS r FROM customer), p AS (SELECT k, r, 0 AS step, CAST(0 AS DOUBLE) AS a, r AS f0, CAST(0 AS DOUBLE) AS f1 FROM c UNION ALL SELECT k, r, step + 1, a + f0 - f1, r, round((a + f0 - f1) * 0.5) FROM p WHERE step < 5)
    SELECT k, CAST(step + 1 AS DOUBLE) AS time, CAST(0 AS INTEGER) AS transition, CAST(f0 AS BIGINT) AS multiplicity, CAST(step AS BIGINT) AS step FROM p WHERE f0 > 0 UNION ALL SELECT k, step + 1, 1, f1, step FROM p WHERE f1 > 0""",
)
def event_log_files(spark, sf_dir):
    """The counted events of a run with fixed flows, written as text and read back."""
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1.0 + F.col("c_custkey") % 7).alias("r"), F.col("c_custkey").alias("seed"))
    log = simulate.event_log(simulate.chain_binomial(cells, _inflow(), 0.0, 6.0, 1.0), _inflow(), ["k"], 0.0, 1.0)
    path = fresh(spark, "log")
    # Event logs have no column for the cell, so each cell's file would be its own; here the cell travels as a weight.
    sinks.write_event_log(log.withColumn("lineage_weights", F.array(F.col("k").cast("double"))), path + ".tsv", "tsv")
    back = tables.read_event_log(spark, path + ".tsv")
    return back.select(F.col("lineage_weights")[0].cast("long").alias("k"), "time", "transition", "multiplicity", "step")


@query("resumed_runs", "SELECT c_custkey AS k, CAST(10 * (1 + c_custkey % 7) AS BIGINT) AS total FROM customer")
def resumed_runs(spark, sf_dir):
    """A run over 0..10 in two parts: the second starts from the stored states of the first."""
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1.0 + F.col("c_custkey") % 7).alias("r"), F.col("c_custkey").alias("seed"))
    path = fresh(spark, "states")
    sinks.write_table(simulate.chain_binomial(cells, _inflow(), 0.0, 6.0, 1.0).where("time = 6").select("k", "time", "A", "B"), path)
    more, model = simulate.resume(cells, spark.read.parquet(path), ["k"], _inflow(), 6.0)
    return simulate.chain_binomial(more, model, 6.0, 10.0, 1.0).where("time = 10").select("k", (F.col("A") + F.col("B")).alias("total"))


@query("line_list_files", f"WITH {EVENTS} SELECT event_id AS individual, CAST(day AS DOUBLE) AS time, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id FROM ev")
def line_list_files(spark, sf_dir):
    """Missing ids are -1 in the file and missing again when read."""
    from pyspark.sql.window import Window as W

    e, none = events(spark, sf_dir), F.lit(None).cast("long")
    rows = e.select(F.col("day").cast("double").alias("time"), none.alias("transition"), F.col("event_id").alias("individual"), none.alias("source"), none.alias("destination"), none.alias("deme"), F.lit("individual").alias("parent_kind"), F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id")).alias("parent_id"), none.alias("parent_deme"), F.lit(0.0).alias("attribution_logprob"))
    path = fresh(spark, "lines.tsv")
    sinks.write_line_list(rows, path, "tsv")
    return tables.read_line_list(spark, path).select("individual", "time", "parent_id")


@query("observation_stream_files", f"WITH {DAILY} SELECT event_type AS stream, CAST(day AS DOUBLE) AS window_start, CAST(day + 1 AS DOUBLE) AS window_stop, CASE WHEN n > 20 THEN v END AS value FROM daily")
def observation_stream_files(spark, sf_dir):
    """One folder per stream with the bounds of each window; holes are NA."""
    d = daily(spark, sf_dir).select(F.col("event_type").alias("stream"), F.col("day").cast("double").alias("window_start"), (F.col("day") + 1).cast("double").alias("window_stop"), F.when(F.col("n") > 20, F.col("v")).alias("value"))
    path = fresh(spark, "streams")
    sinks.write_streams(d, path, layout="window")
    return spark.read.csv(path, header=True, nullValue="NA", schema="window_start double, window_stop double, value double, stream string").select("stream", "window_start", "window_stop", "value")


@query("quantities_with_their_design", "SELECT p_partkey AS point_id, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, count(*) AS n, round(avg(l_quantity), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def quantities_with_their_design(spark, sf_dir):
    """A point quantity of each design point beside the point's parameters."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    design = p.select(F.col("p_partkey").alias("point_id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    q = l.groupBy(F.col("l_partkey").alias("point_id")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("value"))
    out = sinks.quantity_table(q, ["n"], ["point_id"], None, False, design=design)
    return rounded(out.withColumnsRenamed({"sweep:price": "price", "sweep:size": "size"}))


@query("stacked_quantities", 'SELECT \'nation\' AS "group", CAST(c_nationkey AS BIGINT) AS level, NULL AS segment, count(*) AS value FROM customer GROUP BY 2 UNION ALL SELECT \'segment\', NULL, c_mktsegment, count(*) FROM customer GROUP BY 3')
def stacked_quantities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    by_nation = c.groupBy(F.col("c_nationkey").cast("long").alias("level")).agg(F.count("*").alias("value"))
    by_segment = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("value"))
    return sinks.stacked_quantities({"nation": by_nation, "segment": by_segment})


@query("pointwise_score_files", f"WITH {DAILY} SELECT day, round(sum(-v / 1000), 6) AS joint, round(max(CASE WHEN event_type = 'click' THEN -v / 1000 END), 6) AS click FROM daily GROUP BY day")
def pointwise_score_files(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.col("event_type").alias("stream"), "day", (-F.col("v") / 1000).alias("score"))
    path = fresh(spark, "pointwise")
    sinks.write_pointwise(d.groupBy("day").agg(F.sum("score").alias("joint")), d, path)
    joint = spark.read.csv(f"{path}/joint", sep="\t", header=True, schema="day long, joint double")
    own = spark.read.csv(f"{path}/streams", sep="\t", header=True, schema="day long, score double, stream string").where("stream = 'click'")
    return rounded(joint.join(own.select("day", F.col("score").alias("click")), "day", "left"))


@query("prequential_files", f"WITH {DAILY} SELECT event_type AS stream, day AS t, -v AS log_score FROM daily")
def prequential_files(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.col("event_type").alias("stream"), F.col("day").alias("t"), (-F.col("v")).alias("log_score"), F.lit(1.0).alias("ess"))
    stem = fresh(spark, "scores")
    sinks.write_prequential(d.groupBy("t").agg(F.sum("log_score").alias("log_score"), F.max("ess").alias("ess")), d, stem)
    return spark.read.parquet(f"{stem}.streams").select("stream", "t", "log_score")


@query("forecast_files", f"WITH {DAILY} SELECT day AS t_start, count(*) AS n, round(median(v), 4) AS q50 FROM daily GROUP BY day")
def forecast_files(spark, sf_dir):
    from strataflow.operators import bands

    d = daily(spark, sf_dir).withColumnRenamed("day", "t_start")
    path = fresh(spark, "forecast")
    sinks.write_forecast(bands.band(d, ["t_start"], "v"), d, path, {"horizon": 1})
    b = spark.read.parquet(f"{path}/bands").select("t_start", "q50")
    return rounded(spark.read.parquet(f"{path}/samples").groupBy("t_start").agg(F.count("*").alias("n")).join(b, "t_start"), 4)


@query("firing_log_files", "SELECT o_orderpriority AS name, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time, o_orderkey AS step FROM orders WHERE o_totalprice > 300000")
def firing_log_files(spark, sf_dir):
    fired = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("name"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("time"), F.col("o_orderkey").alias("step"))
    path = fresh(spark, "fired")
    sinks.write_firing_log(fired, path)
    return spark.read.csv(path, sep="\t", header=True, schema="name string, time double, step long")


@query("content_leaves", f"WITH {DAILY} SELECT event_type AS kind, count(*) AS n, round(sum(v), 3) AS total, 1 AS leaves FROM daily GROUP BY 1")
def content_leaves(spark, sf_dir):
    """A leaf per event type, asked for twice and made once, and the index of the sealed leaves."""
    d, root = daily(spark, sf_dir), fresh(spark, "store")
    names = [r[0] for r in d.select("event_type").distinct().orderBy("event_type").collect()]
    parts = []
    for name in [*names, *names]:
        parts.append(sinks.content_leaf(spark, root, name, {"event_type": name}, lambda n=name: d.where(F.col("event_type") == n).agg(F.count("*").alias("n"), F.sum("v").alias("total"))).withColumn("kind", F.lit(name)))
    out = parts[len(names)]
    for p in parts[len(names) + 1 :]:
        out = out.unionByName(p)
    index = sinks.leaf_index(spark, root).groupBy("kind").agg(F.count("*").cast("int").alias("leaves"))
    return rounded(out.join(index, "kind").select("kind", "n", "total", "leaves"), 3)


@query("run_records", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F'")
def run_records(spark, sf_dir):
    """Run records as JSON, partitioned by kind; a file that is no record is passed over."""
    root = fresh(spark, "runs")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("label"), F.lit("completed").alias("status"), F.col("o_orderdate").alias("created"), F.lit("pmmh").alias("method"), F.create_map(F.lit("beta"), F.lit(0.3)).alias("parameters"), F.col("o_orderstatus").alias("kind"))
    o.write.partitionBy("kind").json(root)
    spark.createDataFrame([("{not a record",)], "value string").coalesce(1).write.mode("append").text(f"{root}/kind=F")
    return tables.read_run_records(spark, root, "F").select("run_id", "label")
