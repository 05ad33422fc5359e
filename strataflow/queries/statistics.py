"""Bands, scores, chain diagnostics and densities."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strataflow.functions import density, special
from strataflow.operators import bands, diagnostics, scores
from strataflow.queries import query
from strataflow.queries.base import DAILY, EVENTS, daily, events, rounded, table

_QS = ", ".join(f"round(quantile_cont(x, {p}), 4) AS q{round(100 * p):02d}" for p in bands.LEVELS)


@query("price_bands_by_brand", f"SELECT p_brand, count(*) AS n_draws, {_QS.replace('(x,', '(l_extendedprice,')} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def price_bands(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return rounded(bands.band(l.join(p, l.l_partkey == p.p_partkey), ["p_brand"], "l_extendedprice", check=False), 4)


@query("censored_bands", f"WITH c AS (SELECT l_shipdate, l_returnflag, CASE WHEN l_quantity <= 40 THEN l_quantity END AS x FROM lineitem) SELECT l_returnflag, count(*) AS n_draws, count(x) AS n_value, count(*) - count(x) AS n_censored, round((count(*) - count(x)) / count(*), 6) AS p_censored, {_QS} FROM c GROUP BY 1")
def censored_bands(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("x"))
    out = bands.censored_band(l, ["l_returnflag"], "x")
    return out.select(*[F.round(c, 6 if c == "p_censored" else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("nearest_rank_quantiles", "SELECT l_returnflag, " + ", ".join(f"quantile_disc(l_quantity, {p}) AS q{round(100 * p):02d}" for p in (0.25, 0.5, 0.75)) + " FROM lineitem GROUP BY 1")
def nearest_rank(spark, sf_dir):
    return bands.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", (0.25, 0.5, 0.75))


@query(
    "weighted_quantiles",
    """WITH c AS (SELECT l_suppkey, l_discount AS x, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_discount) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS t FROM lineitem)
    SELECT l_suppkey, round(sum(w * x) / sum(w), 6) AS mean, min(x) FILTER (WHERE c >= 0.25 * t * (1 - 1e-12)) AS q25, min(x) FILTER (WHERE c >= 0.5 * t * (1 - 1e-12)) AS q50, min(x) FILTER (WHERE c >= 0.95 * t * (1 - 1e-12)) AS q95 FROM c GROUP BY 1""",
)
def weighted_quantiles(spark, sf_dir):
    return rounded(bands.weighted_quantiles(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity", (0.25, 0.5, 0.95)))


@query(
    "log_mean_exp",
    """WITH x AS (SELECT l_suppkey, -l_extendedprice / 100.0 AS x FROM lineitem), m AS (SELECT *, max(x) OVER (PARTITION BY l_suppkey) AS m FROM x)
    SELECT l_suppkey, count(*) AS n, round(any_value(m) + ln(sum(exp(x - m))), 6) AS log_sum, round(any_value(m) + ln(avg(exp(x - m))), 6) AS log_mean, round(stddev_samp(exp(x - m)) / (avg(exp(x - m)) * sqrt(count(*))), 6) AS log_mean_se FROM m GROUP BY 1""",
)
def log_mean_exp(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (-F.col("l_extendedprice") / 100).alias("x"))
    return rounded(bands.log_mean_exp(l, ["l_suppkey"], "x"))


@query(
    "log_mean_exp_of_infinities",
    """WITH x AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'O' THEN -1 ELSE 0 END AS kind FROM orders),
    g AS (SELECT o_custkey, count(*) AS n, max(kind) AS top, min(kind) AS low FROM x GROUP BY 1)
    SELECT o_custkey, n, CASE WHEN top = 2 THEN 'NaN' WHEN top = 1 THEN 'Infinity' WHEN top = -1 THEN '-Infinity' ELSE 'finite' END AS log_mean, CASE WHEN n = 1 THEN 'finite' WHEN top <> 0 THEN 'NaN' ELSE 'finite' END AS error FROM g""",
)
def log_mean_exp_of_infinities(spark, sf_dir):
    """What infinities and NaN among log values give: one value stands for itself, plus infinity wins over minus infinity."""
    o, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    x = F.when((p == "1-URGENT") & (o == "F"), float("inf")).when((p == "2-HIGH") & (o == "P"), float("nan")).when(o == "O", float("-inf")).otherwise(F.col("o_totalprice") / 1e6)
    got = bands.log_mean_exp(table(spark, sf_dir, "orders").select("o_custkey", x.alias("x")), ["o_custkey"], "x")
    kind = lambda c: F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(F.col(c) > 0, "Infinity").otherwise("-Infinity")).otherwise("finite")
    return got.select("o_custkey", "n", kind("log_mean").alias("log_mean"), kind("log_mean_se").alias("error"))


@query("replicate_totals", "WITH t AS (SELECT l_returnflag, l_linenumber, sum(l_tax) AS total FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS n_replicates, round(avg(total), 4) AS mean_total, round(stddev_samp(total) / sqrt(count(*)), 4) AS mc_se FROM t GROUP BY 1")
def replicate_totals(spark, sf_dir):
    return rounded(bands.replicate_totals(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_tax"), 4)


@query("draw_differences", "WITH a AS (SELECT l_suppkey, avg(l_quantity) AS a FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_suppkey, avg(l_quantity) AS b FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) SELECT l_suppkey, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM a JOIN b USING (l_suppkey)")
def draw_differences(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return rounded(bands.draw_differences(l.where("l_linenumber <= 2"), l.where("l_linenumber > 2"), ["l_suppkey"], "l_quantity"))


@query(
    "paired_mean_difference",
    """WITH e AS (SELECT l_linenumber, count(*) AS n, avg(l_tax - l_discount) AS m, var_samp(l_tax - l_discount) AS v FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 8) AS mean_difference, round(sqrt(sum(n * n * v / n)) / sum(n), 8) AS mc_se FROM e""",
)
def paired_mean_difference(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_tax") - F.col("l_discount"))
    return rounded(bands.mean_difference(l, "l_linenumber", "d"), 8)


def _ordered(spark, sf_dir):
    """Lines with a place that is unique within a chain."""
    return table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_orderkey", "l_extendedprice"))


@query(
    "common_length_chains",
    """WITH c AS (SELECT l_returnflag, l_linenumber, l_tax, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag, l_linenumber) AS n FROM lineitem), m AS (SELECT *, min(n) OVER (PARTITION BY l_returnflag) AS least FROM c)
    SELECT l_returnflag, l_linenumber, count(*) AS n, round(sum(l_tax), 4) AS total FROM m WHERE i <= least GROUP BY 1, 2""",
)
def common_length(spark, sf_dir):
    out = bands.common_length(_ordered(spark, sf_dir), ["l_returnflag"], "l_linenumber", "at")
    return rounded(out.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_tax").alias("total")), 4)


@query(
    "transition_diagnostics",
    """SELECT n_name, CAST(coalesce(sum(f), 0) AS BIGINT) AS n_fired, round(avg(p), 4) AS mean_propensity, coalesce(sum(f), 0) = 0 AS never_fired FROM nation LEFT JOIN (SELECT c_nationkey, CASE WHEN c_acctbal > 9990 THEN 1 ELSE 0 END AS f, c_acctbal AS p FROM customer) ON c_nationkey = n_nationkey GROUP BY 1""",
)
def transition_diagnostics(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_acctbal") > 9990, 1).otherwise(0).cast("long").alias("f"), F.col("c_acctbal").alias("p"))
    return rounded(bands.transition_diagnostics(c, n, "n_nationkey", "f", "p").join(n, "n_nationkey").select("n_name", "n_fired", "mean_propensity", "never_fired"), 4)


def _quantile_sql(p: str) -> str:
    """The same polynomials as :func:`strataflow.functions.special.normal_quantile`, as SQL text."""

    def poly(c, x):
        out = repr(c[0]) + "::DOUBLE"
        for a in c[1:]:
            out = f"({out} * {x} + {a!r}::DOUBLE)"
        return out

    q, u = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    mid = f"{poly(special.ACKLAM_A, f'({q} * {q})')} * {q} / {poly([*special.ACKLAM_B, 1.0], f'({q} * {q})')}"
    tail = f"{poly(special.ACKLAM_C, u)} / {poly([*special.ACKLAM_D, 1.0], u)}"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 1 - 0.02425 THEN -({tail}) ELSE {mid} END)"


def _rhat_sql(source: str, out: str) -> str:
    return f"""{out}_s AS (SELECT g, chain, half, x, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g) AS s FROM {source}),
    {out}_p AS (SELECT *, CAST((r - 0.375) / (s + 0.25) AS DOUBLE) AS p FROM {out}_s), {out}_z AS (SELECT g, chain, half, {_quantile_sql("p")} AS z FROM {out}_p),
    {out}_c AS (SELECT g, chain, half, count(*) AS n, avg(z) AS m, CASE WHEN min(z) = max(z) THEN 0 ELSE var_samp(z) END AS v FROM {out}_z GROUP BY 1, 2, 3),
    {out} AS (SELECT g, sqrt((var_samp(m) * min(n) / avg(v) + min(n) - 1) / min(n)) AS rhat FROM {out}_c GROUP BY 1)"""


CHAINS = "d AS (SELECT l_returnflag AS g, l_linenumber AS chain, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag, l_linenumber) AS n FROM lineitem), h AS (SELECT g, chain, x, CASE WHEN i <= n // 2 THEN 0 ELSE 1 END AS half FROM d WHERE i <= n // 2 OR i > n - n // 2)"


@query(
    "rank_normalised_rhat",
    f"""WITH {CHAINS}, m AS (SELECT g, quantile_cont(x, 0.5) AS med FROM d GROUP BY 1), f AS (SELECT h.g, chain, half, abs(x - med) AS x FROM h JOIN m USING (g)), {_rhat_sql("h", "bulk")}, {_rhat_sql("f", "fold")}
    SELECT bulk.g AS l_returnflag, round(bulk.rhat, 6) AS rhat_bulk, round(fold.rhat, 6) AS rhat_folded, round(greatest(bulk.rhat, fold.rhat), 6) AS rhat, CASE WHEN greatest(bulk.rhat, fold.rhat) < 1.05 THEN 'converged' WHEN greatest(bulk.rhat, fold.rhat) < 1.1 THEN 'not_converged' WHEN greatest(bulk.rhat, fold.rhat) < 1.5 THEN 'high' ELSE 'severe' END AS band FROM bulk JOIN fold ON bulk.g = fold.g""",
)
def rank_rhat(spark, sf_dir):
    """Line numbers as chains, order keys as draws."""
    l = _ordered(spark, sf_dir)
    out = diagnostics.rank_rhat(l, ["l_returnflag"], "l_linenumber", "at", "l_extendedprice")
    return rounded(out.withColumn("band", diagnostics.rhat_band(F.col("rhat"))))


@query("chain_ess")
def chain_ess(spark, sf_dir):
    """Bulk and tail effective sample size (checked against an independent version in the tests)."""
    l = _ordered(spark, sf_dir)
    return rounded(diagnostics.chain_ess(l, ["l_returnflag"], "l_linenumber", "at", "l_extendedprice", common=True), 4)


@query(
    "convergence_status",
    """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, count(*) AS k, min(n) AS a, max(n) AS b, min(lo) AS lo, max(hi) AS hi, bool_and(lo = hi) AS frozen FROM c GROUP BY 1)
    SELECT l_suppkey, k AS n_chains, a AS n_draws, CASE WHEN k < 2 THEN 'too_few_chains' WHEN a <> b THEN 'unequal_chains' WHEN a < 4 THEN 'too_few_draws' WHEN lo = hi THEN 'constant' END AS refusal, frozen AND lo <> hi AS all_frozen FROM g""",
)
def convergence_status(spark, sf_dir):
    return diagnostics.convergence_status(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_tax")


@query(
    "newey_west_evidence",
    f"""WITH {DAILY}, d AS (SELECT a.event_type, a.day, b.n - a.n AS d FROM daily a JOIN daily b ON a.day = b.day AND b.event_type = 'view' WHERE a.event_type <> 'view'),
    c AS (SELECT *, d - avg(d) OVER (PARTITION BY event_type) AS c, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
    t AS (SELECT event_type, count(*) AS n, sum(d) AS total, sum(c * c) AS g0, least(floor(4 * pow(count(*) / 100.0, 2.0 / 9)), count(*) - 1) AS l FROM c GROUP BY 1),
    g AS (SELECT a.event_type, b.i - a.i AS k, sum(a.c * b.c) AS g FROM c a JOIN c b ON a.event_type = b.event_type JOIN t ON t.event_type = a.event_type WHERE b.i - a.i BETWEEN 1 AND greatest(l, 1) GROUP BY 1, 2),
    s AS (SELECT t.event_type, n, total, l, max(g0) AS g0, sum(CASE WHEN k <= l THEN 2 * (1 - k / (l + 1)) * g ELSE 0 END) AS w, sum(CASE WHEN k = 1 THEN g END) AS g1 FROM t LEFT JOIN g ON g.event_type = t.event_type GROUP BY 1, 2, 3, 4)
    SELECT event_type, n, CAST(total AS DOUBLE) AS total, CAST(l AS INTEGER) AS nw_lag, round(sqrt(greatest(g0 + w, 0)), 6) AS nw_se, round(g1 / g0, 6) AS lag1, round(sqrt((n - 1) / n), 6) AS small_sample FROM s""",
)
def newey_west_evidence(spark, sf_dir):
    d = daily(spark, sf_dir)
    base = d.where("event_type = 'view'").select("day", F.col("n").alias("nb"))
    paired = d.where("event_type <> 'view'").join(base, "day").withColumn("d", (F.col("nb") - F.col("n")).cast("double"))
    return rounded(diagnostics.newey_west(paired, ["event_type"], "day", "d"))


@query(
    "evidence_labels",
    f"""WITH x AS (SELECT p_partkey, p_retailprice / 100.0 - 10 AS d, p_size / 5.0 AS se FROM part) SELECT p_partkey, CASE WHEN se > 0 AND abs(d) < 2 * se THEN 'within_noise' WHEN abs(d) * {diagnostics.DECIBANS!r} < 5 THEN 'indeterminate' WHEN abs(d) * {diagnostics.DECIBANS!r} < 10 THEN 'substantial' WHEN abs(d) * {diagnostics.DECIBANS!r} < 15 THEN 'strong' WHEN abs(d) * {diagnostics.DECIBANS!r} < 20 THEN 'very strong' WHEN abs(d) * {diagnostics.DECIBANS!r} < 40 THEN 'decisive' ELSE 'overwhelming' END AS evidence FROM x""",
)
def evidence_labels(spark, sf_dir):
    d, se = F.col("p_retailprice") / 100 - 10, F.col("p_size") / 5
    return table(spark, sf_dir, "part").select("p_partkey", diagnostics.evidence_label(d, se).alias("evidence"))


@query(
    "model_comparison",
    f"""WITH {DAILY}, s AS (SELECT event_type, day, -abs(n - avg(n) OVER (PARTITION BY event_type)) / 10 AS a, -abs(n - median(n) OVER (PARTITION BY event_type)) / 10 AS b FROM daily) SELECT event_type, count(*) AS n, round(sum(a), 6) AS elpd_base, round(sum(b), 6) AS elpd, round(sum(b - a), 6) AS delta_elpd, round(sum(b - a) * 10 / ln(10), 5) AS decibans, count(*) FILTER (WHERE b > a) AS better FROM s GROUP BY 1""",
)
def model_comparison(spark, sf_dir):
    """Score differences of two predictors per stream, paired on time."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("event_type")
    d = daily(spark, sf_dir)
    a = d.select("event_type", "day", (-F.abs(F.col("n") - F.avg("n").over(w)) / 10).alias("s"))
    b = d.select("event_type", "day", (-F.abs(F.col("n") - F.median("n").over(w)) / 10).alias("s"))
    out = scores.compare(a, b, ["event_type"], "day", "s").select("event_type", "n", "elpd_base", "elpd", "delta_elpd", "decibans")
    wins = a.withColumnRenamed("s", "a").join(b.withColumnRenamed("s", "b"), ["event_type", "day"]).groupBy("event_type").agg(F.count_if(F.col("b") > F.col("a")).alias("better"))
    return rounded(out).withColumn("decibans", F.round("decibans", 5)).join(wins, "event_type")


@query(
    "chain_outliers",
    f"""WITH c AS (SELECT l_returnflag AS g, l_linenumber AS chain, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) / sqrt(count(*)) AS se, count(*) AS w FROM lineitem GROUP BY 1, 2),
    t AS (SELECT *, count(*) OVER p AS k, sum(w) OVER p - w AS rest, sum(w * m) OVER p - w * m AS wm, sum(w * w * se * se) OVER p - w * w * se * se AS wv FROM c WINDOW p AS (PARTITION BY g))
    SELECT g AS l_returnflag, chain AS l_linenumber, round(m - wm / rest, 4) AS diff, round(abs(m - wm / rest) / sqrt(se * se + wv / (rest * rest)), 5) AS z, round(-{_quantile_sql("(0.001::DOUBLE / (2 * k))")}, 6) AS cutoff FROM t""",
)
def chain_outliers(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"), (F.stddev_samp("l_extendedprice") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("w"))
    out = diagnostics.chain_outliers(l, ["l_returnflag"], "l_linenumber", "m", "se", "w")
    return out.select("l_returnflag", "l_linenumber", F.round("diff", 4).alias("diff"), F.round("z", 5).alias("z"), F.round("cutoff", 6).alias("cutoff"))


@query("optimiser_agreement", "WITH b AS (SELECT o_custkey, o_totalprice, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS v, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders) SELECT o_custkey, count(*) AS n_near, max(v) - min(v) AS spread, max(best) AS best, count(*) >= 2 AND max(v) - min(v) <= 5000 AS agrees FROM b WHERE best - o_totalprice <= 5000 GROUP BY 1")
def optimiser_agreement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("v", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double"))
    return diagnostics.agreement(o, ["o_custkey"], "v", "o_totalprice", 5000.0)


@query("weights_ess", "WITH m AS (SELECT l_suppkey, l_quantity / 10 AS x, max(l_quantity / 10) OVER (PARTITION BY l_suppkey) AS top FROM lineitem) SELECT l_suppkey, count(*) AS n, round(sum(exp(x - top)) ** 2 / sum(exp(x - top) ** 2), 6) AS ess, round(var_samp(x), 6) AS log_weight_variance FROM m GROUP BY 1")
def weights_ess(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") / 10).alias("x"))
    return rounded(diagnostics.weights_ess(l, ["l_suppkey"], "x"))


@query("ess_profile_worst", "WITH p AS (SELECT l_suppkey, avg(l_quantity) AS mean_ess, min(l_quantity) AS min_ess, count(*) FILTER (WHERE l_quantity < 5) AS n_collapsed FROM lineitem GROUP BY 1) SELECT l_suppkey, round(mean_ess, 6) AS mean_ess, min_ess, n_collapsed, mean_ess < 0.5 AS starved FROM p ORDER BY mean_ess, l_suppkey LIMIT 5")
def ess_profile(spark, sf_dir):
    """The five observations with the least effective sample size (a top-k report)."""
    out = diagnostics.ess_profile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 50)
    return rounded(out.orderBy("mean_ess", "l_suppkey").limit(5))


@query(
    "step_audit",
    """WITH l AS (SELECT l_suppkey, l_linenumber, avg(l_extendedprice) / 1000 AS ll, stddev_samp(l_extendedprice) / 1000 / sqrt(count(*)) AS se, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS i FROM lineitem GROUP BY 1, 2),
    g AS (SELECT l_suppkey, max(ll) FILTER (WHERE i = 1) AS l1, max(ll) FILTER (WHERE i = 2) AS l2, arg_max(ll, i) AS ln, greatest(2.0, 4 * max(se)) AS tau, coalesce(max(se) FILTER (WHERE i > 1) > 2 * max(se) FILTER (WHERE i = 1), false) AS inflated FROM l GROUP BY 1)
    SELECT l_suppkey, round(l1 - l2, 6) AS leg1, round(l1 - ln, 6) AS leg2, round(tau, 6) AS tau, inflated AS se_inflation, CASE WHEN abs(l1 - l2) < tau AND abs(l1 - ln) < tau THEN 'pass' WHEN abs(l1 - l2) < tau AND abs(l1 - ln) < 2 * tau THEN 'marginal' ELSE 'fail' END AS verdict FROM g""",
)
def step_audit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg((F.avg("l_extendedprice") / 1000).alias("ll"), (F.stddev_samp("l_extendedprice") / 1000 / F.sqrt(F.count("*"))).alias("se"))
    return rounded(diagnostics.step_audit(l, ["l_suppkey"], "l_linenumber", "ll", "se", 2.0))


@query("step_log_scores", f"WITH {EVENTS}, m AS (SELECT event_type, day, -value / 50 AS x, max(-value / 50) OVER (PARTITION BY event_type, day) AS m FROM ev) SELECT event_type, day, round(max(m) + ln(avg(exp(x - m))), 6) AS log_score FROM m GROUP BY 1, 2")
def step_log_scores(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", -F.col("value") / 50)
    return rounded(scores.step_log_score(e, ["event_type", "day"], "x"))


@query(
    "fair_crps",
    f"""WITH {EVENTS}, y AS (SELECT event_type, round(avg(value), 6) AS y FROM ev GROUP BY 1), s AS (SELECT event_type, day, value AS x, y, row_number() OVER (PARTITION BY event_type, day ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type, day) AS n FROM ev JOIN y USING (event_type))
    SELECT event_type, day, CAST(max(n) AS BIGINT) AS n_samples, round(avg(abs(x - y)) - CASE WHEN max(n) > 1 THEN sum((2 * i - n - 1) * x) / (max(n) * (max(n) - 1)) ELSE 0 END, 6) AS crps FROM s GROUP BY 1, 2""",
)
def fair_crps(spark, sf_dir):
    e = events(spark, sf_dir)
    y = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("y"))
    return rounded(scores.fair_crps(e.join(y, "event_type"), ["event_type", "day"], "value", "y"))


@query(
    "pit_coverage",
    f"""WITH {EVENTS}, y AS (SELECT user_id, arg_min(value, event_id) AS y FROM ev GROUP BY 1), p AS (SELECT user_id, avg(CASE WHEN value < y THEN 1.0 ELSE 0 END) + 0.5 * avg(CASE WHEN value = y THEN 1.0 ELSE 0 END) AS pit FROM ev JOIN y USING (user_id) GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN pit BETWEEN 0.05 AND 0.95 THEN 1.0 ELSE 0 END), 6) AS coverage FROM p""",
)
def pit_coverage(spark, sf_dir):
    e = events(spark, sf_dir)
    y = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("y"))
    return rounded(scores.coverage(scores.randomised_pit(e.join(y, "user_id"), ["user_id"], "value", "y", F.lit(0.5)), []).select("n", "coverage"))


@query(
    "held_out_split",
    f"""WITH {DAILY}, r AS (SELECT event_type, day, day + 1 AS stop, n, CASE WHEN day + 1 <= 20 THEN 'trained' ELSE 'held_out' END AS role FROM daily), t AS (SELECT event_type, role, md5(concat_ws('|', CAST(day AS VARCHAR), CAST(n AS VARCHAR))) AS h FROM r) SELECT event_type, role, count(*) AS n_rows, md5(string_agg(h, ',' ORDER BY h)) AS digest FROM t GROUP BY 1, 2""",
)
def held_out_split(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("start", F.col("day")).withColumn("stop", F.col("day") + 1)
    rows = scores.split_at(d, ["event_type"], "stop", 20)
    return scores.row_digest(rows, ["event_type", "role"], ["day", "n"])


@query("surprises", f"WITH {DAILY}, m AS (SELECT event_type, day, round(-abs(v - avg(v) OVER (PARTITION BY event_type)), 4) AS log_score FROM daily) SELECT event_type, day, log_score FROM m ORDER BY log_score, event_type, day LIMIT 5")
def surprises(spark, sf_dir):
    from pyspark.sql.window import Window as W

    d = daily(spark, sf_dir)
    return scores.surprises(d.select("event_type", "day", F.round(-F.abs(F.col("v") - F.avg("v").over(W.partitionBy("event_type"))), 4).alias("log_score")), "log_score")


@query("forecast_targets", "WITH s AS (SELECT r_name AS stream, CAST(r_regionkey + 3 AS DOUBLE) AS period FROM region) SELECT stream, 100 + (lead - 1) * period AS t_start, 100 + lead * period AS t_stop, lead * period AS horizon, CAST(lead AS INTEGER) AS lead FROM s, unnest(range(1, 20)) AS u(lead) WHERE lead <= floor(30 / period)")
def forecast_targets(spark, sf_dir):
    s = table(spark, sf_dir, "region").select(F.col("r_name").alias("stream"), (F.col("r_regionkey") + 3).cast("double").alias("period"))
    return scores.forecast_targets(s, 100.0, 30.0)


@query(
    "joint_forecast_scores",
    """WITH d AS (SELECT l_suppkey, l_linenumber, sum(-l_quantity / 100) AS l FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(l) OVER (PARTITION BY l_suppkey) AS m FROM d) SELECT l_suppkey, round(max(m) + ln(avg(exp(l - m))), 6) AS log_score, round(stddev_samp(exp(l - m)) / (avg(exp(l - m)) * sqrt(count(*))), 6) AS se FROM m GROUP BY 1""",
)
def joint_forecast(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("d", -F.col("l_quantity") / 100)
    return rounded(scores.joint_forecast_score(l, ["l_suppkey"], ["l_linenumber"], "d"))


@query(
    "scenario_contrast",
    f"""WITH {DAILY}, s AS (SELECT day % 3 AS k, day, event_type, v FROM daily WHERE event_type IN ('click', 'error')) SELECT k, arg_max(v, day) FILTER (WHERE event_type = 'click') AS a, arg_max(v, day) FILTER (WHERE event_type = 'error') AS b, arg_max(v, day) FILTER (WHERE event_type = 'click' AND day < 15) AS at_fork, round(arg_max(v, day) FILTER (WHERE event_type = 'error') - arg_max(v, day) FILTER (WHERE event_type = 'click'), 4) AS delta FROM s GROUP BY k""",
)
def scenario_contrast(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("k", F.col("day") % 3)
    return rounded(scores.scenario_contrast(d, "event_type", "click", "error", ["k"], "day", "v", 15), 4)


def _lgamma_sql(x: str) -> str:
    y = f"(({x}) - 1)"
    series = " + ".join([f"{special.LANCZOS[0]!r}::DOUBLE", *[f"{c!r}::DOUBLE / ({y} + {i})" for i, c in enumerate(special.LANCZOS[1:], 1)]])
    return f"({0.5 * math.log(2 * math.pi)!r}::DOUBLE + ({y} + 0.5) * ln({y} + 7.5) - ({y} + 7.5) + ln({series}))"


_CHOOSE = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@query(
    "log_densities",
    f"""WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS y, CAST(p_retailprice AS DOUBLE) / 60 AS m FROM part), n AS (SELECT *, lgamma(y + 3) - lgamma(y + 1) - lgamma(3.0) + 3 * ln(3 / (3 + m)) + y * ln(m / (3 + m)) AS negbin FROM x)
    SELECT p_partkey, round(y * ln(m) - m - lgamma(y + 1), 6) AS poisson, round(negbin, 6) AS negbin, round(ln(0.7) + negbin, 6) AS zero_inflated, round(-0.5 * ((y - m) / 4) ** 2 - ln(4) - 0.5 * ln(2 * pi()), 6) AS normal,
    round({_CHOOSE.format(n="60.0", k="y")} + y * ln(0.4) + (60 - y) * ln(0.6), 6) AS binomial, round(ln(CASE WHEN y > 25 THEN 0.3 ELSE 0.7 END), 6) AS bernoulli,
    round({_CHOOSE.format(n="60.0", k="y")} + lgamma(y + 2) + lgamma(60 - y + 5) - lgamma(67.0) - (lgamma(2.0) + lgamma(5.0) - lgamma(7.0)), 6) AS beta_binomial, round((0.3 * 8 - 1) * ln(y / 60) + (0.7 * 8 - 1) * ln(1 - y / 60) + lgamma(8.0) - lgamma(0.3 * 8) - lgamma(0.7 * 8), 6) AS beta FROM n""",
)
def log_densities(spark, sf_dir):
    """Eight observation families; DuckDB's own lgamma is the witness (the ninth has discretised_normal_mass)."""
    y, m = F.col("p_size").cast("double"), F.col("p_retailprice") / 60
    hit = F.when(y > 25, 1.0).otherwise(0.0)
    return rounded(
        table(spark, sf_dir, "part").select(
            "p_partkey", density.poisson(y, m).alias("poisson"), density.negative_binomial(y, m, F.lit(3.0)).alias("negbin"), density.zero_inflated_negative_binomial(y, m, F.lit(3.0), F.lit(0.3)).alias("zero_inflated"), density.normal(y, m, F.lit(4.0)).alias("normal"),
            density.binomial(y, F.lit(60.0), F.lit(0.4)).alias("binomial"), density.bernoulli(hit, F.lit(0.3)).alias("bernoulli"), density.beta_binomial(y, F.lit(60.0), F.lit(2.0), F.lit(5.0)).alias("beta_binomial"), density.beta(y / 60, F.lit(0.3), F.lit(8.0)).alias("beta"),
        )
    )


@query(
    "discretised_normal_mass",
    """WITH RECURSIVE k AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM k WHERE i < 2000), x AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS y FROM part), s AS (SELECT y, (y - 0.5 - 20) / 6 AS a, 1.0 / 6 AS w FROM x)
    SELECT y, round(ln(sum(exp(-0.5 * (a + w * (i - 0.5) / 2000) ** 2) / sqrt(2 * pi()) * w / 2000)), 4) AS log_mass FROM s, k GROUP BY y""",
)
def discretised_normal_mass(spark, sf_dir):
    """Normal mass of whole numbers, against a sum of 2000 thin slices in SQL."""
    y = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("y")).distinct()
    return rounded(y.select("y", density.discretised_normal(F.col("y"), F.lit(20.0), F.lit(36.0)).alias("log_mass")), 4)


@query(
    "log_priors",
    """WITH x AS (SELECT p_partkey, p_size / 60.0 AS x FROM part) SELECT p_partkey, CAST(0 AS DOUBLE) AS flat, round(CASE WHEN x BETWEEN 0.1 AND 0.9 THEN -ln(x) - ln(ln(9.0)) END, 6) AS log_uniform, round(-0.5 * ((x - 0.3) / 0.2) ** 2 - ln(0.2) - 0.5 * ln(2 * pi()), 6) AS normal,
    round(-0.5 * (x / 0.5) ** 2 - ln(0.5) - 0.5 * ln(2 * pi()) + ln(2), 6) AS half_normal, round(-0.5 * ((ln(x) + 1) / 0.7) ** 2 - ln(0.7) - 0.5 * ln(2 * pi()) - ln(x), 6) AS log_normal, round(2 * ln(5.0) - lgamma(2.0) + ln(x) - 5 * x, 6) AS gamma,
    round(lgamma(5.0) - lgamma(2.0) - lgamma(3.0) + ln(x) + 2 * ln(1 - x), 6) AS beta FROM x""",
)
def log_priors(spark, sf_dir):
    """Priors besides those of prior_and_transform; outside its support a prior is minus infinity, here shown as missing."""
    x, p = F.col("p_size") / 60.0, density.prior
    seen = lambda c: F.when(c != float("-inf"), c)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", p(x, "flat").alias("flat"), seen(p(x, "log_uniform", 0.1, 0.9)).alias("log_uniform"), p(x, "normal", 0.3, 0.2).alias("normal"), p(x, "half_normal", 0.5).alias("half_normal"), p(x, "log_normal", -1.0, 0.7).alias("log_normal"), p(x, "gamma", 2.0, 5.0).alias("gamma"), p(x, "beta", 2.0, 3.0).alias("beta")))


@query(
    "transforms_and_back",
    """WITH x AS (SELECT p_partkey, p_size / 60.0 AS x FROM part) SELECT p_partkey, round(x, 6) AS identity, round(ln(x + 1), 6) AS lower, round(-ln(2 - x), 6) AS upper, round(ln((ln(x) - ln(0.001)) / (ln(1.5) - ln(x))), 6) AS log_interval,
    round(x, 6) AS lower_back, round(x, 6) AS upper_back, round(x, 6) AS log_interval_back, round(ln(x + 1), 6) AS lower_jacobian, round(ln(2 - x), 6) AS upper_jacobian FROM x""",
)
def transforms_and_back(spark, sf_dir):
    x, there, back = F.col("p_size") / 60.0, density.transform, density.inverse_transform
    z = {"lower": there(x, "lower", -1.0), "upper": there(x, "upper", None, 2.0), "log_interval": there(x, "log_interval", 0.001, 1.5)}
    bounds = {"lower": (-1.0, None), "upper": (None, 2.0), "log_interval": (0.001, 1.5)}
    columns = [c.alias(k) for k, c in z.items()] + [back(c, k, *bounds[k])[0].alias(f"{k}_back") for k, c in z.items()] + [back(z[k], k, *bounds[k])[1].alias(f"{k}_jacobian") for k in ("lower", "upper")]
    return rounded(table(spark, sf_dir, "part").select("p_partkey", there(x, "identity").alias("identity"), *columns))


@query(
    "support_checks",
    """WITH x AS (SELECT l_quantity AS k, l_discount AS d, CASE WHEN l_tax = 0.08 THEN 'Infinity'::DOUBLE ELSE l_tax END AS t FROM lineitem), v AS (SELECT 'binomial' AS family, CASE WHEN k > 45 THEN 'more successes than trials' END AS violation FROM x UNION ALL SELECT 'poisson', CASE WHEN d <> floor(d) THEN 'not a count' END FROM x
      UNION ALL SELECT 'bernoulli', CASE WHEN k NOT IN (0, 1) THEN 'neither 0 nor 1' END FROM x UNION ALL SELECT 'normal', CASE WHEN isinf(t) THEN 'not finite' END FROM x)
    SELECT family, violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY 1, 2""",
)
def support_checks(spark, sf_dir):
    """All four reasons why a value can't come from a family."""
    l = table(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_tax") == 0.08, float("inf")).otherwise(F.col("l_tax"))
    checks = {"binomial": density.support_violation(F.col("l_quantity"), "binomial", F.lit(45)), "poisson": density.support_violation(F.col("l_discount"), "poisson"), "bernoulli": density.support_violation(F.col("l_quantity"), "bernoulli"), "normal": density.support_violation(tax, "normal")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("violation")) for k, v in checks.items()])).alias("c")
    return l.select(each).select("c.*").where("violation is not null").groupBy("family", "violation").agg(F.count("*").alias("n"))


@query(
    "prior_and_transform",
    """WITH x AS (SELECT p_partkey, p_size / 60.0 AS x FROM part) SELECT p_partkey, round(ln(2.0) - 2 * x, 6) AS exponential, CASE WHEN x BETWEEN 0.1 AND 0.5 THEN round(-ln(0.4), 6) ELSE CAST('-inf' AS DOUBLE) END AS uniform, round(ln((x - 0) / (1 - x)), 6) AS z, round(ln(x) + ln(1 - x), 6) AS log_jacobian FROM x""",
)
def prior_and_transform(spark, sf_dir):
    x = F.col("p_size") / 60.0
    z = density.transform(x, "interval", 0.0, 1.0)
    _, jac = density.inverse_transform(z, "interval", 0.0, 1.0)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", density.prior(x, "exponential", 2.0).alias("exponential"), density.prior(x, "uniform", 0.1, 0.5).alias("uniform"), z.alias("z"), jac.alias("log_jacobian")))


@query(
    "incomplete_gamma",
    """WITH p AS (SELECT p_size AS a, round(p_retailprice / 50) AS x, count(*) AS n FROM part GROUP BY ALL),
    q AS (SELECT a, x, n, list_sum(list_transform(range(a), lambda k: exp(k * ln(x) - x - lgamma(k + 1.0)))) AS q FROM p)
    SELECT a, x, n, round(1 - q, 9) AS lower, round(q, 9) AS upper FROM q""",
)
def incomplete_gamma(spark, sf_dir):
    """Both parts at whole shapes, where the upper one is a sum of Poisson terms."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("a"), F.round(F.col("p_retailprice") / 50).alias("x")).agg(F.count("*").alias("n"))
    return p.select("a", "x", "n", F.round(special.gamma_p(F.col("a"), F.col("x")), 9).alias("lower"), F.round(special.gamma_q(F.col("a"), F.col("x")), 9).alias("upper"))


@query(
    "gamma_quantiles_of_sizes",
    """WITH RECURSIVE s AS (SELECT p_size AS a, count(*) AS n FROM part GROUP BY 1), c AS (SELECT a, n, CAST(sum(n) OVER (ORDER BY a) AS DOUBLE) / CAST(sum(n) OVER () + 1 AS DOUBLE) AS p FROM s),
    b AS (SELECT a, n, p, 0.0::DOUBLE AS lo, 400.0::DOUBLE AS hi, 0 AS i FROM c UNION ALL
      SELECT a, n, p, CASE WHEN 1 - q < p THEN m ELSE lo END, CASE WHEN 1 - q < p THEN hi ELSE m END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(range(a), lambda k: exp(k * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(k + 1.0)))) AS q FROM b WHERE i < 60))
    SELECT a, n, round(p, 6) AS p, round(lo, 5) AS quantile FROM b WHERE i = 60""",
)
def gamma_quantiles_of_sizes(spark, sf_dir):
    """The gamma quantile of each part size at the share of parts up to it, against bisection."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("a")).agg(F.count("*").alias("n"))
    counts = sizes.join(sizes.select(F.col("a").alias("b"), F.col("n").alias("m")), F.col("b") <= F.col("a")).groupBy("a", "n").agg(F.sum("m").alias("upto"))
    total = sizes.agg((F.sum("n") + 1.0).alias("total"))
    rows = counts.crossJoin(total).select("a", "n", (F.col("upto") / F.col("total")).alias("share"))
    return rows.select("a", "n", F.round("share", 6).alias("p"), F.round(special.gamma_p_inverse(F.col("a"), F.col("share")), 5).alias("quantile"))
