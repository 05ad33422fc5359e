"""Aggregates over draws: quantile bands, weighted quantiles, log-mean-exp, paired differences, replicate totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import refuse_any
from strataflow.functions.arithmetic import finite
from strataflow.operators.order import interpolated, joined_by, ordered_counts

#: Fixed levels of a band.
LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _name(p: float) -> str:
    return f"q{round(100 * p):02d}"


def band(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = LEVELS, check: bool = True) -> DataFrame:
    """Linearly interpolated quantiles; a value that is not finite is refused."""
    if check:
        refuse_any(df.where(F.col(value).isNotNull() & ~finite(F.col(value).cast("double"))), "a band needs finite values")
    rows = ordered_counts(df.withColumn("_v", F.col(value).cast("double")), by, "_v")
    return rows.groupBy(*by).agg(F.sum("_all").alias("n_draws"), *[interpolated(p, "_v").alias(_name(p)) for p in levels])


def censored_band(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """A band over the values that are there, with the number and share of the missing ones."""
    n, out = F.sum("_all"), F.sum("_all") - F.sum("_c")
    rows = ordered_counts(df.withColumn("_v", F.col(value).cast("double")), by, "_v")
    return rows.groupBy(*by).agg(n.alias("n_draws"), F.sum("_c").alias("n_value"), out.alias("n_censored"), (out / n).alias("p_censored"), *[interpolated(p, "_v").alias(_name(p)) for p in levels])


def nearest_rank(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...]) -> DataFrame:
    """The smallest value whose rank reaches p * n."""
    rows = ordered_counts(df.where(F.col(value).isNotNull()), by, value)
    pick = lambda p: F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(p * F.col("_total")), F.lit(1)), F.col(value)))
    return rows.groupBy(*by).agg(*[pick(p).alias(_name(p)) for p in levels])


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Weighted mean and, per level, the least value whose cumulative weight share reaches it; rows of weight 0 don't count."""
    rows = ordered_counts(df.where((F.col(weight) > 0) & F.col(value).isNotNull()), by, value, weight)
    # The last cumulative weight may fall short of the total by rounding.
    picks = [F.coalesce(F.min(F.when(F.col("_upto") >= p * F.col("_total") * (1 - 1e-12), F.col(value))), F.max(value)).alias(_name(p)) for p in levels]
    return rows.groupBy(*by).agg((F.sum(F.col("_c") * F.col(value)) / F.sum("_c")).alias("mean"), *picks)


def from_log_weights(df: DataFrame, by: list[str], log_weight: str) -> DataFrame:
    """Adds ``weight``: weights scaled to sum to 1 within the group, without overflow."""
    top = df.groupBy(*by).agg(F.max(log_weight).alias("_top"))
    raw = joined_by(df, top, by).withColumn("_w", F.exp(F.col(log_weight) - F.col("_top")))
    return joined_by(raw, raw.groupBy(*by).agg(F.sum("_w").alias("_all")), by).withColumn("weight", F.try_divide(F.col("_w"), F.col("_all"))).drop("_w", "_top", "_all")


def log_mean_exp(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """log of the sum and the mean of exp(x), with the delta-method standard error of the latter.

    One value stands for itself and has error 0, whatever it is.  Among several a NaN gives NaN; plus infinity gives plus
    infinity, and minus infinity alone itself, both with error NaN.
    """
    ends = [float("-inf"), float("inf")]
    rows = joined_by(df, df.groupBy(*by).agg(F.max(value).alias("_top")), by).withColumn("_e", F.when(F.col("_top").isin(ends), F.lit(0.0)).otherwise(F.exp(F.col(value) - F.col("_top"))))
    n, s = F.count(value), F.sum("_e")
    out = rows.groupBy(*by).agg(n.alias("n"), F.max("_top").alias("_m"), s.alias("_s"), F.stddev_samp("_e").alias("_sd"))
    none = F.col("_m").isin(ends)
    lse = F.when(none | (F.col("n") == 1), F.col("_m")).otherwise(F.col("_m") + F.log(F.col("_s")))
    se = F.when(F.col("n") == 1, F.lit(0.0)).when(none, F.lit(float("nan"))).otherwise(F.try_divide(F.col("_sd") * F.sqrt("n"), F.col("_s")))
    return out.select(*by, "n", lse.alias("log_sum"), (lse - F.log("n")).alias("log_mean"), se.alias("log_mean_se"))


def sample_sd(value: Column | str) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def replicate_totals(df: DataFrame, by: list[str], replicate: str, value: str) -> DataFrame:
    """Mean and Monte Carlo error of per-replicate totals; the error is missing for a single replicate."""
    totals = df.groupBy(*by, replicate).agg(F.sum(value).alias("total"))
    n = F.count("*")
    return totals.groupBy(*by).agg(n.alias("n_replicates"), F.avg("total").alias("mean_total"), F.when(n >= 2, F.stddev_samp("total") / F.sqrt(n)).alias("mc_se"))


def mixture(df: DataFrame, step: list[str], log_density: str) -> DataFrame:
    """Log of the mean density over draws at each step: densities are averaged, not their logs."""
    return log_mean_exp(df, step, log_density).select(*step, F.col("log_mean").alias("log_score"))


def draw_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Difference of the particle means of each draw."""
    left = a.groupBy(*keys).agg(F.avg(value).alias("a"))
    right = b.groupBy(*keys).agg(F.avg(value).alias("b"))
    return left.join(right, keys).withColumn("delta", F.col("b") - F.col("a"))


def mean_difference(deltas: DataFrame, chain: str, delta: str, ess: DataFrame | None = None) -> DataFrame:
    """Mean paired difference; each chain's error comes from its effective sample size, or from its size."""
    each = deltas.groupBy(chain).agg(F.count("*").alias("n"), F.avg(delta).alias("m"), F.var_samp(delta).alias("v"))
    each = each.join(ess, chain) if ess is not None else each.withColumn("ess", F.col("n").cast("double"))
    total = F.sum("n")
    se = F.when(F.min("n") >= 2, F.sqrt(F.sum(F.col("n") * F.col("n") * F.col("v") / F.col("ess"))) / total)
    return each.agg(total.alias("n"), (F.sum(F.col("n") * F.col("m")) / total).alias("mean_difference"), se.alias("mc_se"))


def common_length(df: DataFrame, by: list[str], chain: str, order: str) -> DataFrame:
    """Rows of each chain up to the length of the shortest chain of the group; adds ``i`` from 1."""
    i = F.row_number().over(W.partitionBy(*by, chain).orderBy(order))
    n = F.count("*").over(W.partitionBy(*by, chain))
    rows = df.withColumn("i", i).withColumn("_n", n)
    rows = rows.withColumn("_least", F.min("_n").over(W.partitionBy(*by)))
    return rows.where("i <= _least").drop("_n", "_least")


def transition_diagnostics(steps: DataFrame, transitions: DataFrame, name: str, fired: str, propensity: str) -> DataFrame:
    """Firings, mean propensity and whether a transition never fired; transitions without a step appear."""
    found = steps.groupBy(name).agg(F.sum(fired).alias("n_fired"), F.avg(propensity).alias("mean_propensity"))
    out = transitions.select(name).distinct().join(found, name, "left").withColumn("n_fired", F.coalesce("n_fired", F.lit(0)))
    return out.withColumn("never_fired", F.col("n_fired") == 0)
