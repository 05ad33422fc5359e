"""Lineage projections: events of a user as moves of an individual, customers as a forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import lineage
from strataflow.operators.tours import tours
from strataflow.queries import query
from strataflow.queries.base import EVENTS, events, rounded, table

# Customer k was infected by customer k // 3; its time is k days; multiples of 400 are roots.
FOREST = "f AS (SELECT c_custkey AS child, CASE WHEN c_custkey // 3 = 0 OR c_custkey % 400 = 0 THEN NULL ELSE c_custkey // 3 END AS parent, CAST(c_custkey AS DOUBLE) AS time FROM customer)"


def _forest(spark, sf_dir):
    k = F.col("c_custkey")
    up = F.floor(k / 3).cast("long")
    return table(spark, sf_dir, "customer").select(k.alias("child"), F.when((up != 0) & (k % 400 != 0), up).alias("parent"), k.cast("double").alias("time"))


@query("forest_leaves", f"WITH {FOREST} SELECT child, time FROM f WHERE child NOT IN (SELECT parent FROM f WHERE parent IS NOT NULL)")
def forest_leaves(spark, sf_dir):
    return lineage.leaves(_forest(spark, sf_dir))


@query(
    "forest_shape",
    f"""WITH RECURSIVE {FOREST}, r AS (SELECT child, child AS root, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.child, r.root, r.depth + 1 FROM f JOIN r ON f.parent = r.child), t AS (SELECT child FROM f WHERE child NOT IN (SELECT parent FROM f WHERE parent IS NOT NULL)), b AS (SELECT f.child, coalesce(f.time - p.time, 0) AS branch FROM f LEFT JOIN f p ON f.parent = p.child)
    SELECT root, count(*) AS n_nodes, count(t.child) AS n_tips, CAST(coalesce(sum(depth) FILTER (WHERE t.child IS NOT NULL), 0) AS BIGINT) AS sackin, sum(branch) AS branch_length FROM r JOIN b ON b.child = r.child LEFT JOIN t ON t.child = r.child GROUP BY root""",
)
def forest_shape(spark, sf_dir):
    return lineage.tree_shape(_forest(spark, sf_dir))


@query(
    "pruned_forest",
    f"""WITH RECURSIVE {FOREST}, s AS (SELECT child FROM f SEMI JOIN orders ON o_custkey = child AND o_orderpriority = '1-URGENT'), a AS (SELECT f.child, f.parent FROM f JOIN s ON f.child = s.child UNION SELECT f.child, f.parent FROM f JOIN a ON f.child = a.parent), k AS (SELECT parent AS child, count(*) AS kids FROM (SELECT DISTINCT * FROM a) WHERE parent IS NOT NULL GROUP BY 1)
    SELECT a.child, a.parent IS NULL OR s.child IS NOT NULL OR coalesce(kids, 0) <> 1 AS keep, s.child IS NOT NULL AND coalesce(kids, 0) > 0 AS pendant FROM (SELECT DISTINCT * FROM a) a LEFT JOIN k ON k.child = a.child LEFT JOIN s ON s.child = a.child""",
)
def pruned_forest(spark, sf_dir):
    f = _forest(spark, sf_dir)
    s = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("child")).distinct()
    return lineage.compressed(lineage.pruned(f, s), s).select("child", "keep", "pendant")


@query(
    "merged_trees",
    f"""WITH RECURSIVE {FOREST}, s AS (SELECT c_custkey AS child, c_custkey + c_acctbal AS seen FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey),
    a AS (SELECT f.child, f.parent, f.time FROM f JOIN s ON f.child = s.child UNION SELECT f.child, f.parent, f.time FROM f JOIN a ON f.child = a.parent),
    k AS (SELECT parent AS child, count(*) AS kids FROM a WHERE parent IS NOT NULL GROUP BY 1),
    n AS (SELECT a.*, s.seen, coalesce(kids, 0) AS kids, s.child IS NOT NULL OR coalesce(kids, 0) <> 1 AS keep FROM a LEFT JOIN k ON k.child = a.child LEFT JOIN s ON s.child = a.child),
    w AS (SELECT n.child, n.parent AS up FROM n WHERE keep UNION ALL SELECT w.child, n.parent FROM w JOIN n ON n.child = w.up WHERE NOT n.keep),
    u AS (SELECT w.child, w.up FROM w LEFT JOIN n ON n.child = w.up WHERE w.up IS NULL OR n.keep)
    SELECT n.child AS node, u.up AS parent, round(CASE WHEN seen IS NOT NULL AND kids = 0 THEN seen ELSE n.time END, 4) AS time, round(CASE WHEN seen IS NOT NULL AND kids = 0 THEN seen ELSE n.time END - p.time, 4) AS branch, seen IS NOT NULL AND kids = 0 AS is_tip, n.child AS individual FROM n JOIN u ON u.child = n.child LEFT JOIN f p ON p.child = u.up WHERE n.keep
    UNION ALL SELECT -child - 1, child, round(seen, 4), round(seen - time, 4), true, child FROM n WHERE seen IS NOT NULL AND kids > 0""",
)
def merged_trees(spark, sf_dir):
    """Trees of the customers with an urgent order, without the nodes in between that only pass a line on."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    s = table(spark, sf_dir, "customer").join(urgent, "c_custkey").select(F.col("c_custkey").alias("child"), (F.col("c_custkey") + F.col("c_acctbal")).alias("sampled_at"))
    return rounded(lineage.merged(_forest(spark, sf_dir), s), 4)


# The tour's order is that of the paths: a node opens at its path, and closes after all paths that begin with it.
TOURED = f"""{FOREST}, r AS (SELECT child, child AS root, parent, time, 0 AS depth, [child] AS path FROM f WHERE parent IS NULL UNION ALL SELECT f.child, r.root, f.parent, f.time, r.depth + 1, list_append(r.path, f.child) FROM f JOIN r ON f.parent = r.child),
    k AS (SELECT parent AS child, min(child) AS eldest FROM f WHERE parent IS NOT NULL GROUP BY 1)"""
NUMBER = r"regexp_replace(CAST(CAST(round(r.time - p.time, 6) AS DECIMAL(38, 6)) AS VARCHAR), '\.?0+$', '')"


@query(
    "newick_trees",
    f"""WITH RECURSIVE {TOURED}, a AS (
      SELECT r.root, path AS place, CASE WHEN e.eldest < r.child THEN ',' ELSE '' END || CASE WHEN k.eldest IS NULL THEN '' ELSE '(' END AS text FROM r LEFT JOIN k ON k.child = r.child LEFT JOIN k e ON e.child = r.parent
      UNION ALL SELECT r.root, list_append(path, 9000000000000000000), CASE WHEN k.eldest IS NULL THEN '' ELSE ')' END || r.child || CASE WHEN r.parent IS NULL THEN ';' ELSE ':' || {NUMBER} END FROM r LEFT JOIN k ON k.child = r.child LEFT JOIN f p ON p.child = r.parent)
    SELECT root, string_agg(text, '' ORDER BY place) AS newick FROM a GROUP BY root""",
)
def newick_trees(spark, sf_dir):
    return lineage.newick(_forest(spark, sf_dir))


@query(
    "subtree_sums",
    f"""WITH RECURSIVE {TOURED}, u AS (SELECT child, unnest(path) AS above FROM r)
    SELECT r.child, r.root, CAST(r.depth AS BIGINT) AS depth, count(*) AS size, round(sum(c_acctbal), 2) AS balance FROM r JOIN u ON u.above = r.child JOIN customer ON c_custkey = u.child GROUP BY ALL""",
)
def subtree_sums(spark, sf_dir):
    """Size and account balance of every customer's subtree, off the tours."""
    f = _forest(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), "c_acctbal"), "child")
    return tours(f, {"balance": F.col("c_acctbal")}).select("child", "root", "depth", "size", F.round("balance", 2).alias("balance"))


MOVES = f"{EVENTS}, m AS (SELECT user_id, event_id AS t, event_type AS deme, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ev)"


@query("migration_events", f"WITH {MOVES} SELECT before AS from_deme, deme AS to_deme, count(*) AS n FROM m WHERE before <> deme GROUP BY 1, 2")
def migration_events(spark, sf_dir):
    m = lineage.migrations(events(spark, sf_dir), "user_id", "event_id", "event_type")
    return m.groupBy("from_deme", "to_deme").agg(F.count("*").alias("n"))


@query("individual_summary", f"WITH {EVENTS} SELECT user_id, min(event_id) AS first_time, max(event_id) AS last_time, count(*) AS n_events, arg_min(event_type, event_id) AS first_deme, arg_max(event_type, event_id) AS last_deme FROM ev GROUP BY 1")
def individual_summary(spark, sf_dir):
    return lineage.individuals(events(spark, sf_dir), "user_id", "event_id", "event_type")


@query("deme_at_time", f"WITH {EVENTS} SELECT user_id, arg_max(event_type, event_id) AS deme FROM ev WHERE event_id <= 4000 GROUP BY 1")
def deme_at_time(spark, sf_dir):
    return lineage.deme_at(events(spark, sf_dir), "user_id", "event_id", "event_type", 4000)


@query("cross_deme_fraction", f"WITH {MOVES} SELECT count(*) AS n, round(avg(CASE WHEN before <> deme THEN 1.0 ELSE 0 END), 6) AS cross_deme_fraction FROM m WHERE before IS NOT NULL")
def cross_deme_fraction(spark, sf_dir):
    from pyspark.sql.window import Window as W

    e = events(spark, sf_dir).withColumn("parent_deme", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")))
    return rounded(lineage.cross_deme_fraction(e, "event_type", "parent_deme"))


@query(
    "sojourns",
    f"""WITH {EVENTS}, k AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 END AS k FROM ev WHERE event_type IN ('view', 'purchase')), p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM k),
    t AS (SELECT * FROM p WHERE (k = 1 AND coalesce(prev, -1) = -1) OR (k = -1 AND prev = 1)), s AS (SELECT user_id, event_id AS in_time, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS out_time, k FROM t)
    SELECT user_id, in_time, CAST(out_time AS DOUBLE) AS out_time, CAST(out_time - in_time AS DOUBLE) AS dwell, out_time IS NULL AS censored FROM s WHERE k = 1""",
)
def sojourns(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1)
    out = lineage.sojourns(events(spark, sf_dir), "user_id", "event_id", kind)
    return out.withColumns({"out_time": F.col("out_time").cast("double"), "dwell": F.col("dwell").cast("double")})


@query("sampled_individuals", "SELECT c_custkey, c_nationkey FROM customer WHERE CAST('0x' || substr(md5(concat_ws(':', '11', CAST(c_custkey AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 + c_nationkey * 0.01")
def sampled_individuals(spark, sf_dir):
    """Sampling by deme-dependent rates, with uniforms from ids (the sampling is the feature)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rates = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (0.05 + F.col("n_nationkey") * 0.01).alias("rate"))
    return lineage.sample(c, "c_custkey", 11, rates=rates, deme="c_nationkey").select("c_custkey", "c_nationkey")


@query("attribution_likelihood", f"WITH {EVENTS} SELECT event_type, round(sum(ln(value / 1000)), 5) AS log_likelihood, count(value) AS n FROM ev WHERE value > 0 GROUP BY 1")
def attribution_likelihood(spark, sf_dir):
    e = events(spark, sf_dir).where("value > 0").withColumn("lp", F.log(F.col("value") / 1000))
    return rounded(lineage.log_likelihood(e, ["event_type"], "lp"), 5)


@query("encoded_demes", "SELECT p_partkey, (p_size % 4) * 10 + p_partkey % 10 AS deme FROM part")
def encoded_demes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("a"), (F.col("p_partkey") % 10).alias("b"))
    return lineage.encode_deme(p, [("a", 4), ("b", 10)]).select("p_partkey", "deme")


@query("event_order_check", "WITH b AS (SELECT l_orderkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS before FROM lineitem) SELECT count(*) AS n_out_of_order FROM b WHERE before > l_shipdate")
def event_order_check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.struct("l_linenumber", "l_partkey", "l_shipdate").alias("at"))
    return lineage.event_order_violations(l, "l_orderkey", "l_shipdate", "at").agg(F.count("*").alias("n_out_of_order"))


@query("realized_line_list")
def realized_line_list(spark, sf_dir):
    """Identities for counted events, replayed per run (structure is checked by the tests)."""
    e = events(spark, sf_dir).select((F.col("user_id") % 16).alias("run"), F.col("event_id").alias("step"), F.col("day").cast("double").alias("time"), (F.pmod(F.xxhash64("event_type"), F.lit(3))).cast("long").alias("deme"))
    births = e.withColumn("kind", F.lit("birth")).withColumn("to_deme", F.lit(None).cast("long")).withColumn("weights", F.create_map(F.lit(0).cast("long"), F.lit(1.0), F.lit(1).cast("long"), F.lit(2.0), F.lit(2).cast("long"), F.lit(0.5)))
    return lineage.realize(births, "run", 5)


@query(
    "realized_structure",
    f"""WITH {EVENTS} SELECT user_id % 16 AS run, count(*) AS births, count(*) FILTER (WHERE event_type = 'purchase') AS moves, count(*) FILTER (WHERE event_type = 'error') AS ends, true AS parents_are_older, true AS nobody_acts_after_the_end, true AS demes_follow FROM ev GROUP BY 1""",
)
def realized_structure(spark, sf_dir):
    """Births, moves and ends of a replayed run: as many of each as were counted, parents born before, and pools that add up."""
    # Every event is a birth, a purchase also a move and an error also an end; births come first, all into one pool, so that
    # every later event finds somebody.
    also = F.when(F.col("event_type") == "purchase", "move").when(F.col("event_type") == "error", "end")
    e = events(spark, sf_dir).select((F.col("user_id") % 16).alias("run"), F.explode(F.array_compact(F.array(F.lit("birth"), also))).alias("kind"), F.col("event_id"))
    step = F.col("event_id") + F.when(F.col("kind") == "birth", 0).otherwise(10**9)
    weights = F.create_map(F.lit(0).cast("long"), F.lit(1.0))
    e = e.select("run", step.cast("long").alias("step"), step.cast("double").alias("time"), "kind", F.lit(0).cast("long").alias("deme"), F.when(F.col("kind") == "move", F.lit(1).cast("long")).alias("to_deme"), weights.alias("weights"))
    lines = lineage.realize(e, "run", 5)
    # A line is a row of its individual, and a child's row of its parent, so that all about one individual meets in one shuffle.
    fits = F.col("deme") == F.when(F.col("kind") == "move", 1).otherwise(0)
    own, child = F.struct(F.col("individual").alias("who"), "kind", fits.alias("fits")), F.struct(F.col("parent").alias("who"), F.lit("child").alias("kind"), F.lit(None).cast("boolean").alias("fits"))
    rows = lines.select("run", "step", F.explode(F.array_compact(F.array(own, F.when(F.col("parent").isNotNull(), child)))).alias("r")).select("run", "step", "r.*").repartition("run", "who")
    count, at = lambda k: F.count_if(F.col("kind") == k), lambda k: F.min(F.when(F.col("kind") == k, F.col("step")))
    each = rows.groupBy("run", "who").agg(
        count("birth").alias("births"), count("move").alias("moves"), count("end").alias("ends"), at("birth").alias("born"), at("child").alias("first_child"), at("end").alias("ended"),
        F.max(F.when(F.col("kind") != "child", F.col("step"))).alias("acted"), F.bool_and("fits").alias("fits"),
    )
    return each.groupBy("run").agg(
        *[F.sum(c).alias(c) for c in ("births", "moves", "ends")],
        F.bool_and(F.col("first_child").isNull() | F.coalesce(F.col("born") < F.col("first_child"), F.lit(False))).alias("parents_are_older"),
        F.bool_and((F.col("ends") == 0) | ((F.col("ends") == 1) & (F.col("ended") == F.col("acted")))).alias("nobody_acts_after_the_end"),
        F.bool_and("fits").alias("demes_follow"),
    )
