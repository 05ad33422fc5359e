"""Predictions, path diagnostics, contrasts, diffs, expressions on grids and free aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import density
from strataflow.functions import expr as X
from strataflow.operators import catalog, joins, latent, scores
from strataflow.plans import predict
from strataflow.plans.model import Model, Transition
from strataflow.queries import query
from strataflow.queries.base import DAILY, EVENTS, daily, events, rounded, table


def _steady() -> Model:
    """Whole-number inflow and decay by fixed rules, so that every path can be worked out by SQL."""
    a = X.ref("A")
    return Model(("A",), ("r",), (Transition("inflow", None, "A", X.ref("r"), law="deterministic"), Transition("loss", "A", None, a * X.lift(0.25), law="deterministic")), initial={"A": X.ref("r") * 4})


_STEP = "round(a * 0.25)"
DRAWS = "c AS (SELECT s_suppkey AS chain, 1 AS draw, CAST(8 + s_suppkey % 5 AS DOUBLE) AS r FROM supplier)"


def _draws(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chain"), F.lit(1).cast("long").alias("draw"), (8 + F.col("s_suppkey") % 5).cast("double").alias("r"), F.col("s_suppkey").alias("seed"))


@query(
    "free_forward_paths",
    f"""WITH RECURSIVE {DRAWS}, p AS (SELECT chain, r, 0 AS t, 4 * r AS a FROM c UNION ALL SELECT chain, r, t + 1, a + r - {_STEP} FROM p WHERE t < 12) SELECT chain, CAST(t AS DOUBLE) AS time, CAST(a AS BIGINT) AS "A" FROM p WHERE t % 3 = 0""",
)
def free_forward_paths(spark, sf_dir):
    return predict.free_forward(_draws(spark, sf_dir), _steady(), 0.0, 12.0, 1.0, 3).select("chain", "time", "A")


STATES = "s AS (SELECT chain, r, CAST(k * 2 AS DOUBLE) AS since, 10 + 7 * k + chain % 3 AS a FROM c, range(0, 4) t(k))"


@query(
    "one_step_predictions",
    f"""WITH RECURSIVE {DRAWS}, {STATES}, p AS (SELECT chain, r, since, 0 AS i, CAST(a AS DOUBLE) AS a FROM s UNION ALL SELECT chain, r, since, i + 1, a + r - {_STEP} FROM p WHERE i < 2) SELECT chain, since + 2 AS time, CAST(a AS BIGINT) AS "A" FROM p WHERE i = 2""",
)
def one_step_predictions(spark, sf_dir):
    """Two steps on from each stored state."""
    d = _draws(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    states = d.select("chain", "draw", k).select("chain", "draw", (F.col("k") * 2.0).alias("time"), (10 + 7 * F.col("k") + F.col("chain") % 3).alias("A"))
    return predict.one_step(d, states, _steady(), 2.0, 1.0).select("chain", "time", "A")


@query(
    "forecast_from_the_last_state",
    f"""WITH RECURSIVE {DRAWS}, p AS (SELECT chain, r, 10 AS t, CAST(30 + chain % 7 AS DOUBLE) AS a FROM c UNION ALL SELECT chain, r, t + 1, a + r - {_STEP} FROM p WHERE t < 16) SELECT chain, CAST(t AS DOUBLE) AS time, CAST(a AS BIGINT) AS "A" FROM p WHERE t > 10 AND t % 2 = 0""",
)
def forecast_from_the_last_state(spark, sf_dir):
    d = _draws(spark, sf_dir)
    states = d.select("chain", "draw", F.lit(10.0).alias("time"), (30 + F.col("chain") % 7).alias("A"))
    return predict.forecast(d, states, _steady(), 10.0, 16.0, 1.0, 2).select("chain", "time", "A")


@query("predicted_and_observed", f"WITH {DAILY} SELECT a.day, a.event_type, a.n AS predicted, b.n AS observed FROM daily a JOIN daily b ON a.day = b.day + 1 AND a.event_type = b.event_type")
def predicted_and_observed(spark, sf_dir):
    d = daily(spark, sf_dir)
    late = d.select((F.col("day") + 1).alias("day"), "event_type", F.col("n").alias("observed"))
    return predict.paired_with_data(d.select("day", "event_type", F.col("n").alias("predicted")), late, ["day", "event_type"])


CELLS = "x AS (SELECT l_returnflag AS col, CAST(l_quantity AS BIGINT) AS step, l_linenumber AS chain, l_orderkey AS draw, CASE WHEN l_quantity <= 12 THEN l_linenumber WHEN l_quantity > 40 THEN 5 ELSE l_discount END AS v FROM lineitem)"
STATUS = f"{CELLS}, e AS (SELECT col, step, chain, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1, 2, 3), s AS (SELECT col, step, CASE WHEN min(lo) = max(hi) THEN 'constant' WHEN bool_and(lo = hi) THEN 'frozen_disagree' ELSE 'mixed' END AS status FROM e GROUP BY 1, 2)"


def _cells(spark, sf_dir):
    q = F.col("l_quantity")
    v = F.when(q <= 12, F.col("l_linenumber").cast("double")).when(q > 40, 5.0).otherwise(F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("col"), q.cast("long").alias("step"), F.col("l_linenumber").alias("chain"), F.col("l_orderkey").alias("draw"), v.alias("v"))


@query("latent_statuses", f"WITH {STATUS} SELECT col, step, status FROM s")
def latent_statuses(spark, sf_dir):
    return latent.latent_status(_cells(spark, sf_dir), "col", "step", "chain", "v")


@query(
    "latent_profile",
    f"""WITH {STATUS}, b AS (SELECT min(step) AS a, max(step) AS z, max(step) FILTER (WHERE status = 'frozen_disagree') + 1 AS agree_from FROM s)
    SELECT col, CAST(least((10 * (step - a)) // (z - a + 1), 9) AS INTEGER) AS part, count(*) AS n, round(avg(CASE WHEN status = 'constant' THEN 1.0 ELSE 0 END), 6) AS constant, round(avg(CASE WHEN status = 'frozen_disagree' THEN 1.0 ELSE 0 END), 6) AS frozen_disagree, round(avg(CASE WHEN status = 'mixed' THEN 1.0 ELSE 0 END), 6) AS mixed, agree_from FROM s, b GROUP BY ALL""",
)
def latent_profile(spark, sf_dir):
    return rounded(latent.latent_profile(latent.latent_status(_cells(spark, sf_dir), "col", "step", "chain", "v"), "col", "step"))


@query(
    "renewal_profile",
    f"""WITH {EVENTS}, p AS (SELECT event_type AS chain, day AS sweep, user_id % 40 AS step, max(event_id) % 7 AS x FROM ev GROUP BY 1, 2, 3), m AS (SELECT *, lag(x) OVER w AS before, row_number() OVER w AS n, max(step) OVER (PARTITION BY chain, sweep) AS z FROM p WINDOW w AS (PARTITION BY chain, step ORDER BY sweep)),
    s AS (SELECT chain, sweep, least((10 * step) // (z + 1), 9) AS part, avg(CASE WHEN x <> before THEN 1.0 ELSE 0 END) AS share FROM m WHERE n > 1 GROUP BY ALL), b AS (SELECT part, avg(share) AS m FROM s GROUP BY part)
    SELECT round(max(m) FILTER (WHERE part = 0), 6) AS b0, round(max(m) FILTER (WHERE part = 9), 6) AS b9, round(avg(m) FILTER (WHERE part < 5), 6) AS prefix, round(max(m) FILTER (WHERE part = 9) - max(m) FILTER (WHERE part = 0), 6) AS gradient, max(m) FILTER (WHERE part = 9) - max(m) FILTER (WHERE part = 0) >= 0.75 AS coalesced FROM b""",
)
def renewal_profile(spark, sf_dir):
    """How much of a path changes from one sweep to the next, by tenths of the series."""
    p = events(spark, sf_dir).groupBy(F.col("event_type").alias("chain"), F.col("day").alias("sweep"), (F.col("user_id") % 40).alias("step")).agg((F.max("event_id") % 7).alias("x"))
    out = latent.renewal_profile(latent.renewed_shares(p, "chain", "sweep", "step", ["x"]))
    return rounded(out.select("b0", "b9", "prefix", "gradient", "coalesced"))


@query(
    "single_chain_ess",
    f"""WITH {DAILY}, c AS (SELECT event_type, n - avg(n) OVER (PARTITION BY event_type) AS c, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM daily), t AS (SELECT event_type, count(*) AS n, sum(c * c) AS g FROM c GROUP BY 1),
    l AS (SELECT a.event_type, (b.i - a.i + 1) // 2 AS pair, sum(a.c * b.c) AS p FROM c a JOIN c b ON a.event_type = b.event_type AND b.i > a.i GROUP BY 1, 2),
    r AS (SELECT l.event_type, pair, p / g AS rho, bool_and(p > 0 AND 2 * pair < n) OVER (PARTITION BY l.event_type ORDER BY pair) AS live FROM l JOIN t ON t.event_type = l.event_type)
    SELECT t.event_type, n, round(greatest(n / (1 + 2 * coalesce((SELECT sum(rho) FROM r WHERE r.event_type = t.event_type AND live), 0)), 1), 6) AS ess FROM t""",
)
def single_chain_ess(spark, sf_dir):
    return rounded(latent.chain_length_ess(daily(spark, sf_dir), ["event_type"], "day", "n"))


@query(
    "row_convergence_status",
    """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS n_chains, min(n) AS n_draws, CASE WHEN count(*) < 2 THEN 'too_few_chains' WHEN min(n) <> max(n) THEN 'unequal_chains' WHEN min(n) < 4 THEN 'too_few_draws' WHEN min(lo) = max(hi) THEN 'constant' END AS refusal, CASE WHEN count(*) < 2 OR min(n) <> max(n) OR min(n) < 4 OR min(lo) = max(hi) THEN 'not_assessed' ELSE 'assessed' END AS state FROM c GROUP BY 1""",
)
def row_convergence_status(spark, sf_dir):
    """R-hat for each predictive row, or why there is none (the values are those of rank_normalised_rhat)."""
    out = latent.row_convergence(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_orderkey", "l_tax")
    return out.select("l_suppkey", "n_chains", "n_draws", "refusal", F.when(F.col("band") == "not_assessed", "not_assessed").otherwise("assessed").alias("state"))


@query(
    "numerical_events",
    "SELECT l_returnflag, count(*) FILTER (WHERE l_discount = 0) AS div0, count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0) AS zero_over_zero, count(*) FILTER (WHERE l_tax <= 0) AS log_domain, count(*) FILTER (WHERE l_quantity - 25 < 0) AS sqrt_domain, CAST(0 AS BIGINT) AS not_finite FROM lineitem GROUP BY 1",
)
def numerical_events(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("gap", F.col("l_quantity") - 25)
    return latent.numerical_events(l, ["l_returnflag"], "l_tax", "l_discount", ("l_tax",), ("gap",), ("gap",))


@query("grouping_sets_and_distinct", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS level, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets_and_distinct(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return rounded(l.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity")), 2)


@query("approximate_distinct_is_near", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
def approximate_distinct_is_near(spark, sf_dir):
    """A sketch of distinct keys lies within a tenth of the exact number."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.countDistinct("l_orderkey").alias("n"))
    return l.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query(
    "forecast_arm_contrasts",
    """WITH s AS (SELECT l_returnflag AS arm, l_suppkey AS draw, l_linenumber AS target, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3), d AS (SELECT a.arm, a.target, a.v - b.v AS delta FROM s a JOIN s b ON a.draw = b.draw AND a.target = b.target AND b.arm = 'A' WHERE a.arm <> 'A')
    SELECT arm, target, count(*) AS n_draws, round(avg(delta), 3) AS mean, round(quantile_cont(delta, 0.5), 3) AS q50, round(quantile_cont(delta, 0.95), 3) AS q95 FROM d GROUP BY 1, 2""",
)
def forecast_arm_contrasts(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("draw"), F.col("l_linenumber").alias("target")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(scores.arm_contrasts(s, "arm", "A", ["draw"], ["target"], "v").select("arm", "target", "n_draws", "mean", "q50", "q95"), 3)


@query(
    "run_arithmetic",
    "WITH s AS (SELECT l_suppkey, l_returnflag AS f, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT l_suppkey, max(v) FILTER (WHERE f = 'A') AS a, max(v) FILTER (WHERE f = 'N') AS n, max(v) FILTER (WHERE f = 'R') AS r FROM s GROUP BY 1) SELECT l_suppkey, round(n - a, 4) AS averted, round(a + n + r, 4) AS whole, round(n / 2 - a / 2 - r, 4) AS mixed FROM w",
)
def run_arithmetic(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    terms = {"averted": {"N": 1.0, "A": -1.0}, "whole": {"A": 1.0, "N": 1.0, "R": 1.0}, "mixed": {"N": 0.5, "A": -0.5, "R": -1.0}}
    return rounded(scores.run_arithmetic(s, "l_returnflag", ["l_suppkey"], "v", terms), 4)


@query("overlapping_targets", "WITH t AS (SELECT o_custkey AS stream, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS a, o_orderkey AS k FROM orders), b AS (SELECT *, max(a + 90) OVER (PARTITION BY stream ORDER BY a, a + 90 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS z FROM t) SELECT stream, count(*) AS n FROM b WHERE z > a GROUP BY 1")
def overlapping_targets(spark, sf_dir):
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), day.alias("t_start"), (day + 90).alias("t_stop"))
    return scores.overlapping_targets(t).groupBy("stream").agg(F.count("*").alias("n"))


@query("fit_table_filters", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS label FROM orders WHERE o_orderpriority LIKE '%URGENT' AND starts_with(o_orderstatus, 'F') AND starts_with(CAST(o_orderkey AS VARCHAR), '1') AND o_totalprice > 100000")
def fit_table_filters(spark, sf_dir):
    """Runs of a model and a method by the beginning of their id, with a label and a verdict."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("model"), F.lit("pmmh").alias("method"), F.when(F.col("o_totalprice") > 100000, True).alias("converged"), F.lit("fit").alias("kind"))
    return catalog.list_runs(o, kind="fit", label="*URGENT", model="F", prefix="1", method="pmmh", converged=True).select("run_id", "label")


@query(
    "model_diff_order",
    "WITH l AS (SELECT n_regionkey AS category, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS lp, row_number() OVER (PARTITION BY n_regionkey ORDER BY -n_nationkey, n_name) AS rp FROM nation) SELECT category, name, CAST(lp AS INTEGER) AS left_place, CAST(rp AS INTEGER) AS right_place FROM l WHERE lp <> rp",
)
def model_diff_order(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("category"), F.col("n_name").alias("name"), "n_nationkey")
    return catalog.order_rows(n.withColumn("at", F.col("name")), n.withColumn("at", -F.col("n_nationkey")), "category", "name", "at")


@query("chain_selection_rows", "SELECT c_nationkey, count(*) AS n_rows, c_nationkey NOT IN (3, 4) AS kept FROM customer GROUP BY 1")
def chain_selection_rows(spark, sf_dir):
    return catalog.chain_rows(table(spark, sf_dir, "customer"), drop=[3, 4], chain="c_nationkey")


@query("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 100 FROM nation EXCEPT SELECT s_nationkey + 100 FROM supplier) UNION ALL SELECT DISTINCT c_nationkey + 200 FROM customer")
def set_operations(spark, sf_dir):
    """Levels of both, levels of one, and distinct levels."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s, n = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).unionByName(n.exceptAll(s.distinct()).select((F.col("k") + 100).alias("k"))).unionByName(c.distinct().select((F.col("k") + 200).alias("k")))


@query(
    "expressions_on_a_grid",
    "SELECT p_partkey, CAST(t AS DOUBLE) AS t, round(p_retailprice * exp(-0.1 * t), 6) AS level, round(p_retailprice * exp(-0.1 * t) + p_size + 1, 6) AS total FROM part, range(0, 11) g(t)",
)
def expressions_on_a_grid(spark, sf_dir):
    """Named expressions of parameters and time, one after another; ``total`` sums over compartments named by index."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("S_young_north"), F.lit(1.0).alias("S_old_north"))
    young = X.indexed("S", ("age", "place"), place="north", age="young")
    level = X.ref("price") * X.call("exp", X.lift(-0.1) * X.ref("t"))
    total = X.over_compartments([young.value, "S_old_north"], lambda c: c) + X.ref("level")
    return rounded(X.on_grid(p, {"level": level, "total": total}, 0.0, 10.0, 1.0).select("p_partkey", "t", "level", "total"))


@query(
    "simplex_round_trip",
    "SELECT l_orderkey, l_linenumber, round(ln(l_quantity / (l_quantity + l_extendedprice + 1)), 8) AS z, round(l_quantity / (l_quantity + l_extendedprice + 1), 8) AS share FROM lineitem",
)
def simplex_round_trip(spark, sf_dir):
    """Log ratios of three shares, and back."""
    l = table(spark, sf_dir, "lineitem")
    z = density.to_log_barycentric([F.col("l_quantity"), F.col("l_extendedprice"), F.lit(1.0)])
    return rounded(l.select("l_orderkey", "l_linenumber", z[0].alias("z"), density.from_log_barycentric(z)[0].alias("share")), 8)


@query("sparse_pairs_of_nations", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def sparse_pairs_of_nations(spark, sf_dir):
    """Pairs of levels that share a region: an equi-join instead of a filtered product."""
    n = table(spark, sf_dir, "nation")
    return joins.linked_pairs(n, "n_nationkey", "n_regionkey")
