"""Dimensions, defaults, joins, expressions, catalog queries and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import expr as X
from strataflow.operators import catalog, joins
from strataflow.plans import grid
from strataflow.queries import query
from strataflow.queries.base import DAILY, EVENTS, daily, events, rounded, table
from strataflow.sources import tables


@query("dimension_levels", "WITH f AS (SELECT event_type AS level, min(event_id) AS first FROM events GROUP BY 1) SELECT level, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS ord FROM f")
def dimension_levels(spark, sf_dir):
    return joins.levels(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    "dense_grid_with_default",
    f"""WITH {DAILY}, g AS (SELECT * FROM (SELECT DISTINCT event_type FROM daily) a, (SELECT unnest(range(-2, 33)) AS day) b) SELECT g.event_type, CAST(g.day AS BIGINT) AS day, coalesce(v, 0) AS v FROM g LEFT JOIN daily d ON d.event_type = g.event_type AND d.day = g.day""",
)
def dense_grid(spark, sf_dir):
    d = daily(spark, sf_dir)
    cells = joins.grid(d.select("event_type").distinct(), spark.range(-2, 33).withColumnRenamed("id", "day"))
    return joins.with_default(cells, d.select("event_type", "day", "v"), ["event_type", "day"], "v", 0.0)


@query(
    "missing_cells",
    """SELECT c_custkey, p.o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = p.o_orderpriority)""",
)
def missing_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    cells = joins.grid(table(spark, sf_dir, "customer").select("c_custkey"), o.select("o_orderpriority").distinct())
    return joins.missing_cells(cells, o, ["c_custkey", "o_orderpriority"])


@query("unknown_levels", "SELECT DISTINCT l_partkey, l_suppkey, p_brand || s_name AS level FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_brand || s_name NOT IN (SELECT p_brand || s_name FROM part JOIN supplier ON p_partkey = s_suppkey)")
def unknown_levels(spark, sf_dir):
    """Pairs of brand and supplier that are sold, but aren't among the pairs with equal keys."""
    p, s, l = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    level = F.concat("p_brand", "s_name")
    dim = joins.levels(p.join(s, p.p_partkey == s.s_suppkey).select(level.alias("level"), "p_partkey"), "level", "p_partkey")
    rows = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).select("l_partkey", "l_suppkey", level.alias("level")).distinct()
    return joins.unknown_levels(rows, dim, "level").select("l_partkey", "l_suppkey", "level")


@query(
    "gravity_sum",
    """WITH p AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS pop FROM customer GROUP BY 1) SELECT a.k, round(sum(b.pop / (1 + abs(a.k - b.k))), 4) AS pull FROM p a JOIN p b ON a.k <> b.k GROUP BY a.k""",
)
def gravity_sum(spark, sf_dir):
    """sum(b in dim where b <> a, body) over pairs of a small dimension."""
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("pop"))
    pairs = joins.pairs_where(p.select("k"), "k").join(p.withColumnRenamed("k", "b"), "b")
    return rounded(pairs.groupBy(F.col("a").alias("k")).agg(F.sum(F.col("pop") / (1 + F.abs(F.col("a") - F.col("b")))).alias("pull")), 4)


@query("consecutive_levels", "WITH f AS (SELECT event_type AS level, min(event_id) AS first FROM events GROUP BY 1), l AS (SELECT level, lead(level) OVER (ORDER BY first) AS next_level FROM f) SELECT * FROM l WHERE next_level IS NOT NULL")
def consecutive_levels(spark, sf_dir):
    return joins.consecutive(joins.levels(table(spark, sf_dir, "events"), "event_type", "event_id"))


@query(
    "shared_axis",
    f"""WITH {EVENTS} SELECT user_id, day, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'error') AS error FROM ev WHERE event_type IN ('click', 'error') GROUP BY user_id, day""",
)
def shared_axis(spark, sf_dir):
    """Two of the streams of every user on the days of both."""
    e = events(spark, sf_dir)
    return joins.shared_axis({t: e.where(F.col("event_type") == t) for t in ("click", "error")}, ["user_id"], "day", "value")


@query(
    "paired_scenario_difference",
    """SELECT l_suppkey, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 4) AS a, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS b FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0""",
)
def paired_scenarios(spark, sf_dir):
    """Two arms paired on a shared key, never on their order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("x"))
    return rounded(joins.seed_pairs(l, "l_returnflag", "A", "R", ["l_suppkey"], "x").drop("delta"), 4)


@query(
    "full_outer_pairing",
    f"""WITH {EVENTS}, a AS (SELECT user_id, day, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT user_id, day, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 1, 2) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, CAST(a.n AS DOUBLE) AS a, CAST(b.n AS DOUBLE) AS b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day""",
)
def full_outer_pairing(spark, sf_dir):
    e = events(spark, sf_dir)
    side = lambda t: e.where(F.col("event_type") == t).groupBy("user_id", "day").agg(F.count("*").cast("double").alias("n"))
    return joins.paired_outer(side("purchase"), side("error"), ["user_id", "day"], "n")


@query("chain_selection", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 4) GROUP BY 1")
def chain_selection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey")
    return joins.select_chains(c, drop=[3, 4], chain="c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("first_parent_edges", "WITH f AS (SELECT l_partkey AS child, min((l_shipdate, l_suppkey)) AS m FROM lineitem GROUP BY 1) SELECT child, m[2] AS parent, strftime(m[1], '%Y-%m-%d') AS day FROM f")
def first_parent_edges(spark, sf_dir):
    e = joins.parent_edges(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate")
    return e.select("child", "parent", F.date_format("time", "yyyy-MM-dd").alias("day"))


@query(
    "expression_columns",
    """SELECT p_partkey, round(p_retailprice / (p_size + 1.0), 6) AS per_size, round(pow(p_size, 0.5) + ln(p_retailprice), 6) AS mixed, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END AS big, CAST(p_size % 7 AS DOUBLE) AS wrapped, round(CASE WHEN p_size - 20 > 0 THEN exp(-p_size / 10.0) ELSE tanh(p_size / 10.0) END, 6) AS branch, CAST([5, 6, 7][CAST(floor(p_size / 20.0) AS INTEGER) + 1] AS DOUBLE) AS cell FROM part""",
)
def expression_columns(spark, sf_dir):
    """Trees of named values compiled to columns."""
    size, price = X.ref("size"), X.ref("price")
    scope = X.Scope({"size": F.col("p_size"), "price": F.col("p_retailprice")}, {"steps": F.array(F.lit(5.0), F.lit(6.0), F.lit(7.0))})
    trees = {
        "per_size": price / (size + 1), "mixed": size**0.5 + X.call("log", price), "big": size > 25, "wrapped": size % 7,
        "branch": X.cond(size - 20, X.call("exp", -size / 10), X.call("tanh", size / 10)), "cell": X.table("steps", size / 20),
    }
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *[X.to_column(e, scope).alias(n) for n, e in trees.items()]))


@query(
    "degenerate_arithmetic",
    """WITH x AS (SELECT p_partkey, CAST(p_size % 3 AS DOUBLE) AS d, CAST(p_size AS DOUBLE) AS s FROM part) SELECT p_partkey, CASE WHEN d = 0 THEN 0.0 ELSE round(s / d, 6) END AS zeroed, CASE WHEN d <> 0 THEN round(s / d, 6) END AS missing, CASE WHEN d - 1 < 0 THEN 0.0 ELSE sqrt(d - 1) END AS root, CASE WHEN d <= 0 THEN 0.0 ELSE round(ln(d), 6) END AS logged FROM x""",
)
def degenerate_arithmetic(spark, sf_dir):
    from strataflow.functions import arithmetic as A

    d, s = (F.col("p_size") % 3).cast("double"), F.col("p_size").cast("double")
    out = table(spark, sf_dir, "part").select("p_partkey", A.divide(s, d, "zero").alias("zeroed"), A.divide(s, d, "null").alias("missing"), A.square_root(d - 1, "zero").alias("root"), A.logarithm(d, "zero").alias("logged"))
    return rounded(out)


@query(
    "wide_to_long",
    """SELECT l_orderkey, l_linenumber, stream, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR stream IN (l_quantity, l_tax))""",
)
def wide_to_long(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return l.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "stream", "value")


@query(
    "terminal_states",
    """SELECT l_suppkey AS chain, l_linenumber AS draw, max(epoch(l_shipdate)) AS time, arg_max(l_quantity, (epoch(l_shipdate), l_orderkey)) AS l_quantity FROM lineitem GROUP BY 1, 2""",
)
def terminal_states(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    paths = l.select(F.col("l_suppkey").alias("chain"), F.col("l_linenumber").alias("draw"), F.struct(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double").alias("t"), "l_orderkey").alias("time"), "l_quantity")
    return tables.terminal_states(paths, ["l_quantity"]).select("chain", "draw", F.col("time.t").alias("time"), "l_quantity")


@query("state_at_time", f"WITH {DAILY} SELECT event_type, day, v FROM daily WHERE day = 12")
def state_at_time(spark, sf_dir):
    return tables.state_at(daily(spark, sf_dir).withColumn("time", F.col("day").cast("double")), 12.0).select("event_type", "day", "v")


@query(
    "run_catalog_listing",
    """SELECT o_orderstatus AS kind, count(*) AS n_runs, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders WHERE regexp_full_match(o_orderpriority, '.-.*I.*') GROUP BY 1""",
)
def run_catalog(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("created"))
    return catalog.list_runs(o, label="?-*I*", group="kind").select("kind", "n_runs", F.date_format("created", "yyyy-MM-dd").alias("newest"))


@query("run_catalog_latest", "SELECT o_orderkey AS run_id, o_orderpriority AS label FROM orders WHERE o_orderpriority LIKE '1-%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def run_catalog_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("created"))
    return catalog.list_runs(o, label="1-*", limit=20).select("run_id", "label")


@query(
    "label_history",
    """WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS back FROM orders) SELECT o_custkey, o_orderkey, CAST(back AS INTEGER) AS back FROM h WHERE back <= 2""",
)
def label_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return catalog.label_history(o, "o_custkey", "o_orderdate", "o_orderkey").where("back <= 2").select("o_custkey", "o_orderkey", "back")


@query(
    "prefix_resolution",
    """WITH p AS (SELECT unnest(['1', '12', '123', '1499', '99999']) AS prefix) SELECT prefix, count(o_orderkey) AS n_matches, CASE WHEN count(o_orderkey) = 0 THEN 'unknown' WHEN count(o_orderkey) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM p LEFT JOIN orders ON starts_with(CAST(o_orderkey AS VARCHAR), prefix) GROUP BY prefix""",
)
def prefix_resolution(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"))
    return catalog.prefix_matches(o, spark.createDataFrame([(p,) for p in ("1", "12", "123", "1499", "99999")], "prefix string"))


@query(
    "model_diff",
    """WITH x AS (SELECT DISTINCT o_orderpriority AS p_brand, o_orderdate AS p_type, o_orderstatus AS s FROM orders), l AS (SELECT p_brand, p_type, min(s) AS v FROM x GROUP BY 1, 2), r AS (SELECT o_orderpriority AS p_brand, l_shipdate AS p_type, min(o_orderstatus) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT coalesce(l.p_brand, r.p_brand) AS priority, strftime(coalesce(l.p_type, r.p_type), '%Y-%m-%d') AS day, CASE WHEN r.p_brand IS NULL THEN 'only_left' WHEN l.p_brand IS NULL THEN 'only_right' WHEN l.v = r.v THEN 'same' ELSE 'changed' END AS status FROM l FULL JOIN r ON l.p_brand = r.p_brand AND l.p_type = r.p_type""",
)
def model_diff(spark, sf_dir):
    """Statuses by priority and day, once by the day of the order and once by that of its lines."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    side = lambda df, day: df.groupBy(F.col("o_orderpriority").alias("priority"), F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.min("o_orderstatus").alias("v"))
    return catalog.diff(side(o, "o_orderdate"), side(o.join(l, o.o_orderkey == l.l_orderkey), "l_shipdate"), ["priority", "day"], "v").select("priority", "day", "status")


@query(
    "affected_by_change",
    """WITH RECURSIVE u AS (SELECT n_nationkey AS name, n_nationkey // 2 AS used FROM nation WHERE n_nationkey > 0), a AS (SELECT 2 AS name, 0 AS distance UNION SELECT u.name, a.distance + 1 FROM u JOIN a ON u.used = a.name) SELECT CAST(name AS INTEGER) AS name, CAST(min(distance) AS INTEGER) AS distance FROM a GROUP BY name""",
)
def affected_by(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("name")).where("name > 0")
    uses = n.select("name", F.floor(F.col("name") / 2).cast("int").alias("used"))
    return catalog.affected_by(spark.createDataFrame([(2,)], "name int"), uses)


@query(
    "role_partition",
    """WITH r AS (SELECT CASE WHEN s_acctbal < 0 THEN s_nationkey + 20 ELSE s_nationkey END AS name, count(*) AS n FROM supplier GROUP BY 1) SELECT CAST(coalesce(n_nationkey, name) AS INTEGER) AS name, CASE WHEN n_nationkey IS NULL THEN 'unknown parameter' WHEN coalesce(n, 0) = 0 THEN 'no role' ELSE 'several roles' END AS problem FROM nation FULL JOIN r ON name = n_nationkey WHERE n_nationkey IS NULL OR coalesce(n, 0) <> 1""",
)
def role_partition(spark, sf_dir):
    key = F.when(F.col("s_acctbal") < 0, F.col("s_nationkey") + 20).otherwise(F.col("s_nationkey"))
    roles = table(spark, sf_dir, "supplier").select(key.cast("int").alias("name"), "s_suppkey")
    return catalog.role_violations(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("name")), roles)


@query(
    "sweep_grid",
    """SELECT CAST(a.i * 15 + b.i * 5 + c.i AS BIGINT) AS point_id, round(a.x, 6) AS alpha, round(b.x, 6) AS beta, round(c.x, 6) AS gamma FROM (SELECT unnest([0, 1]) AS i, unnest([1.0, 2.0]) AS x) a, (SELECT unnest([0, 1, 2]) AS i, unnest([0.1, 1.0, 10.0]) AS x) b, (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS x) c""",
)
def sweep_grid(spark, sf_dir):
    return rounded(grid.sweep(spark, {"beta": "log10(0.1,10,3)", "alpha": [1, 2], "gamma": "lin(0,1,5)"}))


@query(
    "run_grid_shape",
    """WITH s AS (SELECT r_name AS scenario FROM region), p AS (SELECT unnest(range(3)) AS point_id), r AS (SELECT unnest(range(4)) AS replicate) SELECT scenario, CAST(point_id AS BIGINT) AS point_id, CAST(replicate AS INTEGER) AS replicate, CAST(5 AS BIGINT) AS arms_per_seed FROM s, p, r""",
)
def run_grid_shape(spark, sf_dir):
    """Cells of scenario x point x replicate; every seed is shared by all scenarios."""
    from pyspark.sql.window import Window as W

    s = table(spark, sf_dir, "region").select(F.col("r_name").alias("scenario"))
    cells = grid.run_grid(s, grid.sweep(spark, {"x": [1, 2, 3]}), 4, 42, draws=True)
    return cells.withColumn("arms_per_seed", F.count("*").over(W.partitionBy("seed"))).select("scenario", "point_id", "replicate", "arms_per_seed")


@query(
    "scenario_parameters",
    """WITH c AS (SELECT r_name AS scenario, CAST(r_regionkey AS INTEGER) AS k FROM region), b AS (SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS value, CAST(n_regionkey AS INTEGER) AS k FROM nation) SELECT scenario, name, CASE WHEN b.k = c.k AND value > 12 THEN 100.0 WHEN b.k = c.k THEN value * 2.0 ELSE value END AS value FROM c, b""",
)
def scenario_parameters(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("value"))
    own = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("scenario"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") > 12, 100.0).alias("set_value"), F.when(F.col("n_nationkey") <= 12, 2.0).alias("scale"))
    return grid.scenario_parameters(base, own)


@query("latin_hypercube")
def latin_hypercube(spark, sf_dir):
    """One point in each stratum of every parameter (checked by the tests)."""
    return rounded(grid.latin_hypercube(spark, {"a": (0.0, 1.0), "b": (0.1, 10.0)}, 500, 7, log=["b"]), 9)


@query(
    "effect_timeline",
    """WITH s AS (SELECT CAST(t AS DOUBLE) AS time, 'output' AS reason, 1 AS rank FROM range(0, 21, 5) x(t) UNION ALL SELECT CAST(t AS DOUBLE), 'effect', 0 FROM range(3, 21, 7) x(t) UNION ALL SELECT 10.0, 'observation', 2 UNION ALL SELECT 20.0, 'end', 3) SELECT time, reason, CAST(rank AS INTEGER) AS rank FROM s""",
)
def effect_timeline(spark, sf_dir):
    one = spark.range(1)
    outputs = one.select(F.explode(F.array(*[F.lit(t) for t in grid.output_times(0.0, 20.0, 5.0)])).alias("time"), F.lit("output").alias("reason"))
    effects = one.select(F.explode(grid.fire_times(F.lit(0.0), F.lit(20.0), at_day=3.0, period=7.0)).alias("time"), F.lit("effect").alias("reason"))
    rest = spark.createDataFrame([(10.0, "observation"), (20.0, "end")], "time double, reason string")
    return grid.timeline(outputs.unionByName(effects).unionByName(rest))
