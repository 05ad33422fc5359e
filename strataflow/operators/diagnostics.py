"""Chain diagnostics: split chains, rank-normal scores, R-hat, effective sample size, Newey-West errors, evidence labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.functions.arithmetic import finite
from strataflow.functions.special import normal_cdf, normal_quantile
from strataflow.operators.chains import chain_ess  # noqa: F401
from strataflow.operators.lags import centred, lag_products
from strataflow.operators.order import interpolated, joined_by, numbered_within, ordered_counts

# Bands of R-hat, evidence steps in decibans, and their labels.
RHAT_STEPS = (1.05, 1.1, 1.5)
EVIDENCE = ((5, "indeterminate"), (10, "substantial"), (15, "strong"), (20, "very strong"), (40, "decisive"))
EVIDENCE_TOP = "overwhelming"
DECIBANS = 10 / math.log(10)


def chain_halves(df: DataFrame, by: list[str], chain: str, order: str) -> DataFrame:
    """Adds ``half`` (0 or 1); null for the middle draw of a chain of odd length."""
    h = F.floor(F.col("_n") / 2)
    rows = numbered_within(df, [*by, chain], order, "_i", "_n")
    return rows.withColumn("half", F.when(F.col("_i") <= h, 0).when(F.col("_i") > F.col("_n") - h, 1)).drop("_i", "_n")


def split_chains(df: DataFrame, by: list[str], chain: str, order: str) -> DataFrame:
    """Adds ``half`` (0 or 1); the middle draw of a chain of odd length goes."""
    return chain_halves(df, by, chain, order).where("half is not null")


def _scored(counts: DataFrame, out: str):
    rank = F.col("_upto") - (F.col("_ties") - 1) / 2
    return counts.where("_c > 0").withColumn(out, normal_quantile((rank - 0.375) / (F.col("_total") + 0.25))).withColumnRenamed("_c", "count")


def rank_scores(df: DataFrame, by: list[str], value: str, out: str = "z", also: Sequence[str] = ()) -> DataFrame:
    """(by, also, value, count, score) of the distinct values: normal scores of pooled average ranks, (r - 3/8) / (S + 1/4)."""
    return _scored(ordered_counts(df, by, value, also=also), out).select(*by, *also, value, "count", out)


def basic_rhat(df: DataFrame, by: list[str], chain: list[str], value: str, out: str = "rhat", count: str | None = None) -> DataFrame:
    """Between- and within-chain variances in two aggregations; constant chains give infinity, one constant value NaN.

    ``count``: a column that says for how many draws a row stands.
    """
    v = F.col(value)
    if count is None:
        n, mean, spread = F.count("*"), F.avg(value), F.var_samp(value)
    else:
        c = F.col(count)
        n, mean = F.sum(c), F.sum(c * v) / F.sum(c)
        spread = F.greatest(F.sum(c * v * v) - n * mean * mean, F.lit(0.0)) / (n - 1)
    each = df.groupBy(*by, *chain).agg(n.alias("n"), mean.alias("m"), F.when(F.min(value) == F.max(value), 0.0).otherwise(spread).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    total = each.groupBy(*by).agg(F.count("*").alias("k"), F.min("n").alias("n"), F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r = F.sqrt((F.try_divide(F.col("b") * F.col("n"), F.col("w")) + F.col("n") - 1) / F.col("n"))
    none = (F.col("k") < 2) | (F.col("n") < 2) | (F.col("lo") == F.col("hi"))
    return total.select(*by, F.when(none, float("nan")).when(F.col("w") == 0, float("inf")).otherwise(r).alias(out))


def rank_rhat(df: DataFrame, by: list[str], chain: str, order: str, value: str) -> DataFrame:
    """rhat_bulk, rhat_folded and their maximum from split chains."""
    draws = chain_halves(df.select(*by, chain, order, value), by, chain, order)
    sides = [chain, "half"]
    counts = ordered_counts(draws, by, value, also=sides, kept=F.col("half").isNotNull())
    bulk = basic_rhat(_scored(counts, "z"), by, sides, "z", "rhat_bulk", "count")
    # Folding looks at all draws, the middle ones too.
    centre = counts.groupBy(*by).agg(interpolated(0.5, value, "_all").alias("_med"))
    folded = joined_by(draws.where("half is not null"), centre, by).withColumn("_f", F.abs(F.col(value) - F.col("_med")))
    folded = basic_rhat(rank_scores(folded, by, "_f", also=sides), by, sides, "z", "rhat_folded", "count")
    both = joined_by(bulk, folded, by)
    worse = F.when(F.isnan("rhat_bulk") | F.isnan("rhat_folded"), float("nan")).otherwise(F.greatest("rhat_bulk", "rhat_folded"))
    return both.withColumn("rhat", worse)


def convergence_status(df: DataFrame, by: list[str], chain: str, value: str) -> DataFrame:
    """Why convergence can't be assessed (null: it can), and whether all chains are frozen."""
    v = F.col(value).cast("double")
    each = df.groupBy(*by, chain).agg(F.count("*").alias("n"), F.count_if(~finite(v)).alias("bad"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    out = each.groupBy(*by).agg(F.count("*").alias("n_chains"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.sum("bad").alias("bad"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.col("lo") == F.col("hi")).alias("all_frozen"))
    why = F.when(F.col("n_chains") < 2, "too_few_chains").when(F.col("n_min") != F.col("n_max"), "unequal_chains").when(F.col("n_min") < 4, "too_few_draws").when(F.col("bad") > 0, "non_finite").when(F.col("lo") == F.col("hi"), "constant")
    return out.select(*by, "n_chains", F.col("n_min").alias("n_draws"), why.alias("refusal"), (F.col("all_frozen") & (F.col("lo") != F.col("hi"))).alias("all_frozen"))


def rhat_band(rhat: Column) -> Column:
    out = F.when(rhat.isNull() | F.isnan(rhat), "not_assessed").when(rhat < RHAT_STEPS[0], "converged")
    return out.when(rhat < RHAT_STEPS[1], "not_converged").when(rhat < RHAT_STEPS[2], "high").otherwise("severe")


def newey_west(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """n, total, se of the sum with Bartlett weights, lag-1 autocorrelation and the small-sample factor of a series.

    The lag is floor(4 (n / 100)^(2/9)); the products of each lag come from blocks with halos, for as many lags as the
    longest series needs (143 for a billion rows), so one series may have most of the rows.
    """
    longest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    max_lag = max(1, math.floor(4 * (longest / 100) ** (2 / 9)) + 1)
    out = lag_products(centred(df, by, order, value), by, value, max_lag)
    lag = F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.col("n") - 1)
    var = F.col("g0")
    for k in range(1, max_lag + 1):
        var = var + F.when(lag >= k, 2 * (1 - k / (lag + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0))).otherwise(0.0)
    se = F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    factor = F.when(F.col("n") < 2, 1.0).otherwise(F.sqrt((F.col("n") - 1) / F.col("n")))
    auto = F.when(F.col("n") >= 3, F.try_divide("g1", "g0"))
    return out.select(*by, "n", "total", lag.cast("int").alias("nw_lag"), se.alias("nw_se"), auto.alias("lag1"), factor.alias("small_sample"))


def evidence_label(delta: Column, se: Column, mc_se: Column | None = None) -> Column:
    db = F.abs(delta) * DECIBANS
    out = F.when(finite(se) & (se > 0) & (F.abs(delta) < 2 * se), "within_noise")
    if mc_se is not None:
        out = out.when(finite(mc_se) & (mc_se > 0) & (F.abs(delta) < 2 * mc_se), "within_filter_noise")
    for top, label in EVIDENCE:
        out = out.when(db < top, label)
    return out.otherwise(EVIDENCE_TOP)


def chain_outliers(df: DataFrame, by: list[str], chain: str, mean: str, se: str, weight: str, alpha: float = 0.001) -> DataFrame:
    """Each chain against the weighted mean of the others: z, cutoff and flag, from group sums without a self-join."""
    g = W.partitionBy(*by)
    rows = df.withColumn("k", F.count("*").over(g))
    w, m, v = F.col(weight), F.col(mean), F.col(se) * F.col(se)
    rest = F.sum(w).over(g) - w
    diff = m - F.try_divide(F.sum(w * m).over(g) - w * m, rest)
    error = F.sqrt(v + F.try_divide(F.sum(w * w * v).over(g) - w * w * v, rest * rest))
    rows = rows.withColumn("diff", diff).withColumn("z", F.try_divide(F.abs(diff), error))
    rows = rows.withColumn("cutoff", -normal_quantile(F.lit(alpha) / (2 * F.greatest("k", F.lit(1)))))
    return rows.withColumn("flagged", F.coalesce(F.col("z") > F.col("cutoff"), F.lit(False)))


def agreement(df: DataFrame, by: list[str], value: str, objective: str, tolerance: float) -> DataFrame:
    """Whether optimiser chains whose objective is near the best one agree on a value."""
    best = F.max(objective).over(W.partitionBy(*by))
    near = df.withColumn("_best", best).where(F.col("_best") - F.col(objective) <= tolerance)
    out = near.groupBy(*by).agg(F.count("*").alias("n_near"), (F.max(value) - F.min(value)).alias("spread"), F.max("_best").alias("best"))
    return out.withColumn("agrees", (F.col("n_near") >= 2) & (F.col("spread") <= tolerance))


def weights_ess(df: DataFrame, by: list[str], log_weight: str) -> DataFrame:
    """Effective sample size and variance of log weights."""
    top = F.max(log_weight).over(W.partitionBy(*by))
    rows = df.withColumn("_w", F.exp(F.col(log_weight) - top))
    s = F.sum("_w")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(s * s, F.sum(F.col("_w") * F.col("_w"))).alias("ess"), F.var_samp(log_weight).alias("log_weight_variance"))


def ess_profile(df: DataFrame, by: list[str], ess: str, particles: int, starved: float = 0.01, collapse: float = 0.1) -> DataFrame:
    """Mean and least ESS per observation, whether it is starved, and how often it fell below the collapse share."""
    out = df.groupBy(*by).agg(F.avg(ess).alias("mean_ess"), F.min(ess).alias("min_ess"), F.count_if(F.col(ess) < collapse * particles).alias("n_collapsed"))
    return out.withColumn("starved", F.col("mean_ess") < starved * particles)


def step_audit(ladder: DataFrame, by: list[str], rung: str, loglik: str, se: str, threshold: float) -> DataFrame:
    """Verdict on halving the step: first and last leg against an error-aware threshold, and error inflation."""
    order = W.partitionBy(*by).orderBy(rung)
    rows = ladder.withColumn("_i", F.row_number().over(order))
    at = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    out = rows.groupBy(*by).agg(F.count("*").alias("rungs"), at(1, loglik).alias("_l1"), at(2, loglik).alias("_l2"), F.max_by(loglik, "_i").alias("_ln"), F.max(se).alias("_smax"), at(1, se).alias("_s1"), F.max(F.when(F.col("_i") > 1, F.col(se))).alias("_srest"))
    tau = F.greatest(F.lit(float(threshold)), 4 * F.col("_smax"))
    leg1, leg2 = F.col("_l1") - F.col("_l2"), F.col("_l1") - F.col("_ln")
    fine = F.abs(leg1) < tau
    verdict = F.when(F.coalesce(fine, F.lit(False)) & (F.abs(leg2) < tau), "pass").when(F.coalesce(fine, F.lit(False)) & (F.abs(leg2) < 2 * tau), "marginal").otherwise("fail")
    inflated = F.coalesce((F.col("_s1") > 0) & (F.col("_srest") > 2 * F.col("_s1")), F.lit(False))
    return out.select(*by, leg1.alias("leg1"), leg2.alias("leg2"), tau.alias("tau"), inflated.alias("se_inflation"), verdict.alias("verdict"))


def acceptance_ceiling(spread: Column) -> Column:
    """Largest acceptance rate that a noisy likelihood allows."""
    return F.when(finite(spread) & (spread >= 0), 2 * normal_cdf(-spread / 2)).otherwise(float("nan"))
