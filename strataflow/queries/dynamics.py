"""Forward simulation, fitting and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import expr as X
from strataflow.operators import bands, reduce
from strataflow.plans import grid, infer, simulate
from strataflow.plans.model import Model, Transition
from strataflow.queries import query
from strataflow.queries.base import rounded, table


def sir() -> Model:
    """Susceptible, infectious, recovered in a closed population; a share rho of infections is reported."""
    beta, gamma, size, s, i = (X.ref(n) for n in ("beta", "gamma", "N", "S", "I"))
    return Model(
        ("S", "I", "R"), ("beta", "gamma", "N", "rho"), (Transition("infection", "S", "I", beta * s * i / size), Transition("recovery", "I", "R", gamma * i)),
        initial={"S": size - 10, "I": X.lift(10), "R": X.lift(0)},
    )


def cells(spark, sf_dir, replicates: int = 1):
    """Scenarios are regions, points a small sweep."""
    scenarios = table(spark, sf_dir, "region").select(F.col("r_name").alias("scenario"))
    points = grid.sweep(spark, {"beta": [0.3, 0.6], "gamma": [0.2]}).withColumn("N", F.lit(10000.0)).withColumn("rho", F.lit(0.5))
    return grid.run_grid(scenarios, points, replicates, 42)


@query(
    "logistic_ode",
    """WITH RECURSIVE g AS (SELECT n_nationkey AS k, 0.05 + n_nationkey / 100.0 AS r FROM nation), p AS (SELECT k, r, 0 AS i, 0.01::DOUBLE AS x FROM g UNION ALL SELECT k, r, i + 1, x + 0.5 * (
        r * x * (1 - x) + 2 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))
        + 2 * r * (x + 0.25 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))) * (1 - (x + 0.25 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))))
        + r * (x + 0.5 * r * (x + 0.25 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))) * (1 - (x + 0.25 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))))) * (1 - (x + 0.5 * r * (x + 0.25 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))) * (1 - (x + 0.25 * r * (x + 0.25 * r * x * (1 - x)) * (1 - (x + 0.25 * r * x * (1 - x)))))))
        ) / 6 FROM p WHERE i < 60)
    SELECT k, i * 0.5 AS time, round(x, 8) AS x FROM p WHERE i % 10 = 0""",
)
def logistic_ode(spark, sf_dir):
    """Fourth-order Runge-Kutta for each nation's growth rate, folded inside Catalyst."""
    r, x = X.ref("r"), X.ref("x")
    model = Model(("x",), ("r",), (Transition("growth", None, "x", r * x * (1 - x)),), initial={"x": X.lift(0.01)})
    start = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (0.05 + F.col("n_nationkey") / 100.0).alias("r"))
    return rounded(simulate.ode(start, model, 0.0, 30.0, 0.5, every=10).select("k", "time", "x"), 8)


@query(
    "decay_with_a_short_last_step",
    """WITH c AS (SELECT c_custkey AS k, (1 + c_custkey % 10) / 10.0 AS z FROM customer), p AS (SELECT k, z, i, z * CASE WHEN i < 4 THEN 0.3 ELSE 0.1 END AS h FROM c, range(1, 5) t(i)),
    f AS (SELECT k, i, 1 - h + h * h / 2 - h * h * h / 6 + h * h * h * h / 24 AS f FROM p), g AS (SELECT k, i, 100 * exp(sum(ln(f)) OVER (PARTITION BY k ORDER BY i)) AS a FROM f),
    s AS (SELECT k, 0 AS i, 100.0 AS a FROM c UNION ALL SELECT k, i, a FROM g)
    SELECT k, round(least(i * 0.3, 1.0), 6) AS time, round(a, 6) AS a, round((100 - a) / 4, 6) AS b, round((100 - a) * 3 / 4, 6) AS c FROM s""",
)
def decay_short_step(spark, sf_dir):
    """A decay that splits 1 : 3, in steps of 0.3 over 0..1: the last step is 0.1 long, and nothing is lost."""
    model = Model(("A", "B", "C"), ("z",), (Transition("decay", "A", None, X.ref("z") * X.ref("A"), branches=(("B", 1.0), ("C", 3.0))),), initial={"A": X.lift(100)})
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ((1 + F.col("c_custkey") % 10) / 10.0).alias("z"))
    return rounded(simulate.ode(cells, model, 0.0, 1.0, 0.3).select("k", "time", F.col("A").alias("a"), F.col("B").alias("b"), F.col("C").alias("c")))


@query(
    "deterministic_flows_and_balance",
    """WITH c AS (SELECT c_custkey AS k, (c_custkey % 40) * 5.0 AS r FROM customer), f AS (SELECT k, r, round(r * CAST(0.3 AS DOUBLE)) AS full_step, round(r * CAST(0.1 AS DOUBLE)) AS last_step FROM c)
    SELECT k, CAST(3 * full_step + last_step AS BIGINT) AS inflow, CAST(1000 - (3 * full_step + last_step) AS BIGINT) AS rest FROM f""",
)
def deterministic_flows(spark, sf_dir):
    """Flows of rate times step, halves rounded away from zero, with a last step that is cut short; ``rest`` closes the budget."""
    model = Model(("A", "rest"), ("r",), (Transition("inflow", None, "A", X.ref("r"), law="deterministic"),), initial={"rest": X.lift(1000)}, balance=("rest", X.lift(1000) - X.ref("A")))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ((F.col("c_custkey") % 40) * 5.0).alias("r"), F.col("c_custkey").alias("seed"))
    return simulate.chain_binomial(cells, model, 0.0, 1.0, 0.3).where("time = 1.0").select("k", F.col("A").alias("inflow"), "rest")


@query(
    "effects_at_half_steps",
    """WITH x AS (SELECT o_orderkey, (o_orderkey % 21) / 4.0 AS t FROM orders) SELECT o_orderkey, CAST(CASE WHEN t > 4 AND 4.6 - t <= t - 4 + 1e-9 THEN 5 WHEN t > 4 THEN 4 ELSE floor(t + 0.5) END AS BIGINT) AS step FROM x WHERE t <= 4.6""",
)
def effects_at_half_steps(spark, sf_dir):
    """Steps of length 1 over 0..4.6: ties go to the later step, and the short last one has ends of its own."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 21) / 4.0).alias("t"))
    return grid.snap(x, "t", 0.0, 1.0, 4.6).select("o_orderkey", "step")


@query(
    "reactive_firings",
    """WITH c AS (SELECT c_custkey AS k, 1 + c_custkey % 9 AS r FROM customer), t AS (SELECT k, r, i FROM c, range(1, 21) g(i)), w AS (SELECT k, min(i) AS i FROM t WHERE r * least(i, 3) >= 12 GROUP BY k),
    e AS (SELECT k, 'once' AS name, i + 2 AS time FROM w WHERE i + 2 <= 20 UNION ALL SELECT k, 'again', w.i + 5 * n FROM w, range(0, 5) g(n) WHERE w.i + 5 * n <= 20)
    SELECT k, name, CAST(time AS DOUBLE) AS time, CAST(time AS BIGINT) AS step FROM e""",
)
def reactive_firings(spark, sf_dir):
    """Two actions on the flow of the last three days: one fires once, two days late, the other at once and every five days."""
    from strataflow.plans.model import Action, Trigger

    watch = dict(flow="inflow", every=1.0, threshold=12.0, window=3.0)
    actions = (Action("once", "add", (), 50, target="A", trigger=Trigger(**watch, delay=2.0, once=True)), Action("again", "add", (), 1, target="A", trigger=Trigger(**watch, cooldown=5.0)))
    model = Model(("A",), ("r",), (Transition("inflow", None, "A", X.ref("r"), law="deterministic"),), actions=actions)
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1.0 + F.col("c_custkey") % 9).alias("r"), F.col("c_custkey").alias("seed"))
    return simulate.chain_binomial(cells, model, 0.0, 20.0, 1.0, firings=True).select("k", "name", "time", "step")


_TWO = {"a": [(1.0, 3.0), (2.0, None), (3.0, 9.0), (4.0, 2.0), (6.0, 7.0)], "b": [(2.0, 5.0), (4.0, 6.0), (5.0, None), (6.0, 1.0)]}


@query(
    "two_stream_scores",
    f"""WITH c AS (SELECT s_suppkey AS point_id, 2.0 + s_suppkey % 7 AS r FROM supplier), o AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {t}, {'NULL' if y is None else y})" for k, s in _TWO.items() for t, y in s)}) v(stream, t, y)),
    w AS (SELECT stream, t, y, t - coalesce(lag(t) OVER (PARTITION BY stream ORDER BY t), 0) AS width FROM o), s AS (SELECT point_id, stream, t, y, CASE WHEN stream = 'a' THEN 0.5 * r ELSE 0.5 * (r + 1) END * width AS m FROM c, w WHERE y IS NOT NULL), d AS (SELECT *, y * ln(m) - m - lgamma(y + 1) AS log_score FROM s)
    SELECT point_id, CAST(t AS DOUBLE) AS t, stream, CAST(y AS DOUBLE) AS y_obs, round(log_score, 6) AS log_score, round(sum(log_score) OVER (PARTITION BY point_id, t), 6) AS joint FROM d""",
)
def two_stream_scores(spark, sf_dir):
    """Two streams with their own times and holes over fixed flows, where every particle is alike and scores are exact."""
    r = X.ref("r")
    model = Model(("A",), ("r", "rho"), (Transition("one", None, "A", r, law="deterministic"), Transition("two", None, "A", r + 1, law="deterministic")))
    streams = {k: infer.Stream(flow, tuple(_TWO[k]), "rho") for k, flow in (("a", "one"), ("b", "two"))}
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (2.0 + F.col("s_suppkey") % 7).alias("r"), F.lit(0.5).alias("rho"), F.col("s_suppkey").alias("seed"))
    return rounded(infer.stream_scores(points, infer.StreamsFilter(model, streams, 0.0, 1.0), 20).drop("ess"))


@query(
    "ode_prequential_scores",
    """WITH c AS (SELECT c_custkey AS k, (1 + c_custkey % 10) / 20.0 AS z FROM customer), f AS (SELECT k, z, 1 - z * 0.5 + (z * 0.5) ** 2 / 2 - (z * 0.5) ** 3 / 6 + (z * 0.5) ** 4 / 24 AS f FROM c), o AS (SELECT * FROM (VALUES (1.0, 12.0), (2.5, 20.0), (4.0, 3.0)) v(t, y)), w AS (SELECT t, y, coalesce(lag(t) OVER (ORDER BY t), 0) AS b FROM o),
    m AS (SELECT k, t, y, 0.5 * 200 * (pow(f, 2 * b) - pow(f, 2 * t)) AS m FROM f, w)
    SELECT k, CAST(t AS DOUBLE) AS t, CAST(y AS DOUBLE) AS y_obs, round(m, 5) AS predicted, round(y * ln(m) - m - lgamma(y + 1), 5) AS log_score FROM m""",
)
def ode_prequential_scores(spark, sf_dir):
    """Scores of three observations under an exponential decay, window by window."""
    model = Model(("A", "B"), ("z", "rho"), (Transition("decay", "A", "B", X.ref("z") * X.ref("A")),), initial={"A": X.lift(200)})
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ((1 + F.col("c_custkey") % 10) / 20.0).alias("z"), F.lit(0.5).alias("rho"))
    seen = spark.createDataFrame([(1.0, 12.0), (2.5, 20.0), (4.0, 3.0)], "t double, y double")
    return rounded(infer.ode_prequential(cells, model, seen, "decay", 0.0, 4.0, 0.5, "rho").select("k", "t", "y_obs", "predicted", "log_score"), 5)


@query("start_rules", "SELECT * FROM (VALUES ('uniform', 64, true), ('unconstrained', 64, true), ('one point', 64, true), ('from draws', 5, true), ('best draws', 5, true)) v(rule, n, legal)")
def start_rules(spark, sf_dir):
    """Every rule gives as many chains as asked for, inside the bounds, with seeds of their own."""
    bounds, fixed = {"beta": (0.2, 0.7), "N": (100.0, 10000.0)}, {"gamma": 0.2}
    draws = table(spark, sf_dir, "part").select((F.col("p_size") / 100 + 0.2).alias("beta"), F.col("p_retailprice").alias("N"), F.col("p_retailprice").alias("ll"))
    found = {
        "uniform": infer.starts_uniform(spark, bounds, fixed, 64, 3, log=("N",)), "unconstrained": infer.starts_unconstrained(spark, bounds, fixed, 64, 3), "one point": infer.starts_at(spark, {"beta": 0.4, "N": 500.0}, 64, 3),
        "from draws": infer.starts_from(draws, ["beta", "N"], 5, 3), "best draws": infer.starts_from(draws, ["beta", "N"], 5, 3, best="ll"),
    }
    rows = None
    for rule, df in found.items():
        inside = F.col("beta").between(0.2, 0.7) & F.col("N").between(100, 10000)
        one = df.agg(F.count("*").cast("int").alias("n"), (F.bool_and(inside) & (F.countDistinct("seed") == F.count("*"))).alias("legal")).select(F.lit(rule).alias("rule"), "n", "legal")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("sir_ode_reductions")
def sir_ode(spark, sf_dir):
    """Peak, final size and attack time per cell (the final size is checked against its equation in the tests)."""
    paths = simulate.ode(cells(spark, sf_dir), sir(), 0.0, 200.0, 0.5, every=4)
    return rounded(reduce.reductions(paths, ["scenario", "point_id"], "time", "I", 100.0), 4)


@query("sir_stochastic_bands")
def sir_stochastic(spark, sf_dir):
    """Chain-binomial runs of every cell and replicate, reduced and banded over replicates."""
    paths = simulate.chain_binomial(cells(spark, sf_dir, 8), sir(), 0.0, 120.0, 0.5, every=2)
    peaks = reduce.reductions(paths, ["scenario", "point_id", "replicate"], "time", "I")
    return rounded(bands.band(peaks, ["scenario", "point_id"], "max", check=False), 4)


@query("sir_event_driven")
def sir_event_driven(spark, sf_dir):
    return simulate.gillespie(cells(spark, sf_dir), sir(), 0.0, 40.0, 10.0).select("scenario", "point_id", "time", "S", "I", "R")


@query(
    "event_driven_totals",
    "SELECT r_name AS scenario, p AS point_id, CAST(10 * k AS DOUBLE) AS time, 10000 AS total, true AS susceptible_never_rise FROM region, range(0, 2) a(p), range(0, 5) b(k)",
)
def event_driven_totals(spark, sf_dir):
    """A closed population stays as large as it was, and nobody becomes susceptible again."""
    from pyspark.sql.window import Window as W

    paths = simulate.gillespie(cells(spark, sf_dir), sir(), 0.0, 40.0, 10.0)
    before = F.lag("S").over(W.partitionBy("scenario", "point_id").orderBy("time"))
    return paths.select("scenario", "point_id", "time", (F.col("S") + F.col("I") + F.col("R")).cast("int").alias("total"), F.coalesce(F.col("S") <= before, F.lit(True)).alias("susceptible_never_rise"))


@query("stochastic_means_are_near", "SELECT n_name, CAST(5 * k AS DOUBLE) AS time, true AS near FROM nation, range(0, 5) t(k)")
def stochastic_means(spark, sf_dir):
    """A pure death process, 100 replicates for each nation's rate: means lie within five errors of the exact ones."""
    model = Model(("A", "B"), ("z",), (Transition("death", "A", "B", X.ref("z") * X.ref("A")),), initial={"A": X.lift(1000)})
    n = table(spark, sf_dir, "nation").select("n_name", (0.02 + F.col("n_nationkey") / 200).alias("z"), F.explode(F.sequence(F.lit(1), F.lit(100))).alias("replicate"))
    runs = simulate.chain_binomial(n.withColumn("seed", F.xxhash64("n_name", "replicate").bitwiseAND(F.lit(2**50 - 1))), model, 0.0, 20.0, 0.5, every=10)
    p = F.exp(-F.col("z") * F.col("time"))
    mean = runs.groupBy("n_name", "time", "z").agg(F.avg("A").alias("m"))
    return mean.select("n_name", "time", (F.abs(F.col("m") - 1000 * p) <= 5 * F.sqrt(1000 * p * (1 - p) / 100) + 1e-9).alias("near"))


@query("latin_hypercube_strata", "SELECT name, CAST(i AS BIGINT) AS stratum, 1 AS n FROM (VALUES ('beta'), ('size')) v(name), range(0, 500) t(i)")
def latin_hypercube_strata(spark, sf_dir):
    """Every one of 500 strata of each parameter holds one point, on the log scale for the second."""
    import math

    points = grid.latin_hypercube(spark, {"beta": (0.2, 0.7), "size": (1.0, 1000.0)}, 500, 11, log=("size",))
    part = {"beta": (F.col("beta") - 0.2) / 0.5 * 500, "size": F.log("size") / math.log(1000) * 500}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.floor(v).alias("stratum")) for k, v in part.items()])).alias("x")
    return points.select(each).groupBy("x.name", "x.stratum").agg(F.count("*").cast("int").alias("n"))


@query("synthetic_observations")
def synthetic_observations(spark, sf_dir):
    paths = simulate.chain_binomial(cells(spark, sf_dir), sir(), 0.0, 60.0, 0.5, every=20)
    return simulate.observe(paths.where("time > 0"), "flow_infection", "negative_binomial", 0.5, 10.0).select("scenario", "point_id", "time", "flow_infection", "observed")


#: Weekly reported infections of one run at beta = 0.4.
WEEKLY = [(7.0, 19.0), (14.0, 58.0), (21.0, 182.0), (28.0, 541.0), (35.0, 1003.0), (42.0, None), (49.0, 624.0), (56.0, 278.0)]


def _filter() -> infer.Filter:
    return infer.Filter(sir(), WEEKLY, "infection", 0.0, 1.0, "rho")


@query("likelihood_survey")
def likelihood_survey(spark, sf_dir):
    """Particle-filter likelihood over a Latin hypercube."""
    starts = infer.starts_within(spark, {"beta": (0.2, 0.7)}, {"gamma": 0.2, "N": 10000.0, "rho": 0.5}, 24, 3)
    return rounded(infer.loglik_grid(starts, _filter(), 200).select("chain", "beta", "loglik", "min_ess"), 6)


@query("prequential_scores")
def prequential_scores(spark, sf_dir):
    points = spark.createDataFrame([(i, b, 0.2, 10000.0, 0.5, 77) for i, b in enumerate((0.38, 0.4, 0.42))], "point_id long, beta double, gamma double, N double, rho double, seed long")
    return rounded(infer.prequential(points, _filter(), 400), 6)


@query("profile_likelihood")
def profile_likelihood(spark, sf_dir):
    """Exact ODE likelihood over a grid, the best start per cell."""
    ll = infer.ode_loglik(sir(), WEEKLY, "infection", 0.0, 0.5, "rho")
    starts = infer.starts_within(spark, {"beta": (0.2, 0.7)}, {"gamma": 0.2, "N": 10000.0, "rho": 0.5}, 4, 5).crossJoin(spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "rho_cell double")).withColumn("rho", F.col("rho_cell"))
    found = infer.nelder_mead(starts.withColumn("chain", F.col("chain") + 100 * (F.col("rho_cell") * 10).cast("long")), sir(), {"beta": (0.2, 0.7)}, ll, 80)
    found = found.withColumn("rho", F.floor(F.col("chain") / 100) / 10).withColumn("start", F.col("chain") % 100)
    return rounded(infer.profile(found, ["rho"]).select("rho", "loglik", "delta"), 4)


@query("posterior_chains")
def posterior_chains(spark, sf_dir):
    """Metropolis on the exact likelihood, then R-hat and effective sample size by the relational operators."""
    from strataflow.operators import diagnostics

    ll = infer.ode_loglik(sir(), WEEKLY, "infection", 0.0, 1.0, "rho")
    starts = infer.starts_within(spark, {"beta": (0.3, 0.5)}, {"gamma": 0.2, "N": 10000.0, "rho": 0.5}, 3, 9)
    draws = infer.metropolis(starts, sir(), {"beta": (0.2, 0.7)}, ll, 120, 80, scale=0.05).withColumn("parameter", F.lit("beta"))
    ess = diagnostics.chain_ess(draws, ["parameter"], "chain", "draw", "beta")
    return rounded(diagnostics.rank_rhat(draws, ["parameter"], "chain", "draw", "beta").join(ess, "parameter"), 4)


@query("streaming_tumbling_counts", "WITH w AS (SELECT time_bucket(INTERVAL 7 DAY, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') AS start, event_type, value FROM events) SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM w GROUP BY 1, 2")
def streaming_tumbling(spark, sf_dir):
    """The events file as a stream, counted in weekly windows; one pass over all files, then the sink's rows."""
    from strataflow.streaming import streams

    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"tumbling_{abs(hash(sf_dir))}"
    q = streams.tumbling_counts(rows, "ts", "7 days", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(600)
    return rounded(spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", "total"), 3)


@query(
    "reservoirs_run_dry",
    """WITH c AS (SELECT c_custkey AS k, greatest(c_acctbal, 0) / 100 AS v, 1.0 + c_custkey % 7 AS o FROM customer), t AS (SELECT unnest([0, 2, 4, 6, 8, 9]) AS time)
    SELECT k, CAST(time AS DOUBLE) AS time, round(greatest(v - o * time, 0), 6) AS v FROM c, t""",
)
def reservoirs_run_dry(spark, sf_dir):
    """A real compartment under a constant outflow stops at 0; the end is an output although it is off the cadence."""
    model = Model(("V",), ("o", "v0"), (Transition("out", "V", None, X.ref("o")),), initial={"V": X.ref("v0")}, real=("V",))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1.0 + F.col("c_custkey") % 7).alias("o"), (F.greatest("c_acctbal", F.lit(0.0)) / 100).alias("v0"))
    return rounded(simulate.ode(cells, model, 0.0, 9.0, 1.0, every=2).select("k", "time", F.col("V").alias("v")))
