"""Diagnostics of stored paths: convergence of every latent cell, renewal between sweeps, ESS of single chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.operators.diagnostics import convergence_status, rank_rhat, rhat_band
from strataflow.operators.lags import centred, lag_products

#: Parts of a series, and the leading ones whose mean is the prefix.
PARTS = 10
PREFIX = PARTS // 2
#: From this difference of last and first part on, a genealogy counts as coalesced.
COALESCED = 0.75


def row_convergence(values: DataFrame, rows: list[str], chain: str, order: str, value: str) -> DataFrame:
    """R-hat of each predictive row over the chains, its band, and why there is none."""
    status = convergence_status(values, rows, chain, value)
    rhat = rank_rhat(values, rows, chain, order, value).select(*rows, "rhat")
    out = status.join(rhat, rows, "left").withColumn("rhat", F.when(F.col("refusal").isNull(), F.col("rhat")))
    return out.select(*rows, "n_chains", "n_draws", "refusal", "rhat", rhat_band(F.col("rhat")).alias("band"))


def latent_status(paths: DataFrame, column: str, step: str, chain: str, value: str) -> DataFrame:
    """(column, step, status): ``constant`` (nothing moved), ``frozen_disagree`` (no chain moved and they differ) or ``mixed``."""
    each = paths.groupBy(column, step, chain).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    whole = each.groupBy(column, step).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.col("lo") == F.col("hi")).alias("frozen"))
    return whole.select(column, step, F.when(F.col("lo") == F.col("hi"), "constant").when(F.col("frozen"), "frozen_disagree").otherwise("mixed").alias("status"))


def latent_profile(status: DataFrame, column: str, step: str) -> DataFrame:
    """Shares of the statuses per column in fixed tenths of the steps, and the step from which no cell is frozen any more."""
    ends = status.agg(F.min(step).alias("_first"), F.max(step).alias("_last"))
    part = F.least(F.floor(PARTS * (F.col(step) - F.col("_first")) / (F.col("_last") - F.col("_first") + 1)), F.lit(PARTS - 1)).cast("int")
    rows = status.join(F.broadcast(ends)).withColumn("part", part)  # one row is broadcast
    share = lambda s: F.avg((F.col("status") == s).cast("double")).alias(s)
    out = rows.groupBy(column, "part").agg(F.count("*").alias("n"), share("constant"), share("frozen_disagree"), share("mixed"))
    frozen = status.where("status = 'frozen_disagree'").agg(F.max(step).alias("_frozen"))
    return out.join(F.broadcast(frozen)).withColumn("agree_from", F.col("_frozen") + 1).drop("_frozen")


def renewed_shares(paths: DataFrame, chain: str, sweep: str, step: str, states: list[str]) -> DataFrame:
    """(chain, sweep, part, share): the share of a tenth's steps at which a sweep's path differs from that of the sweep before."""
    before = W.partitionBy(chain, step).orderBy(sweep)
    moved = F.lit(False)
    for c in states:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(before))
    last = F.max(step).over(W.partitionBy(chain, sweep))
    rows = paths.withColumn("_moved", moved).withColumn("_n", F.row_number().over(before)).withColumn("_last", last).where("_n > 1")
    part = F.least(F.floor(PARTS * F.col(step) / (F.col("_last") + 1)), F.lit(PARTS - 1)).cast("int")
    return rows.groupBy(chain, sweep, part.alias("part")).agg(F.avg(F.col("_moved").cast("double")).alias("share"))


def renewal_profile(shares: DataFrame) -> DataFrame:
    """One row: the mean share of each part over all sweeps that have it, the prefix mean, the gradient and ``coalesced``.

    Shares are averaged over sweeps, not pooled over steps; a part without a step contributes nothing.
    """
    bins = [F.avg(F.when(F.col("part") == i, F.col("share"))).alias(f"b{i}") for i in range(PARTS)]
    out = shares.agg(*bins)
    known = [F.when(F.col(f"b{i}").isNotNull(), 1).otherwise(0) for i in range(PREFIX)]
    prefix = F.try_divide(sum((F.coalesce(f"b{i}", F.lit(0.0)) for i in range(PREFIX)), F.lit(0.0)), sum(known[1:], known[0]))
    gradient = F.col(f"b{PARTS - 1}") - F.col("b0")
    return out.withColumns({"prefix": prefix, "gradient": gradient, "coalesced": gradient >= COALESCED})


def chain_length_ess(draws: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, n, ess) of single chains: n / (1 + 2 sum of autocorrelations), summed over pairs of lags while a pair's sum is positive.

    Lag products come from blocks with halos, so one chain may have most of the rows.  If some chain's pairs are all positive so far, twice as many lags are
    taken, so no chain is cut off.  Under four draws the size is n; a constant chain counts as one draw.
    """
    rows = centred(draws, by, order, value)
    pairs = 4
    while True:
        sums = lag_products(rows, by, value, 2 * pairs).withColumnRenamed("g0", "g").fillna(0.0, [f"g{k}" for k in range(1, 2 * pairs + 1)])
        # Whether all pairs up to this one are positive and inside the chain.
        on, total = F.lit(True), F.lit(0.0)
        for j in range(1, pairs + 1):
            rho = F.try_divide(F.col(f"g{2 * j - 1}") + F.col(f"g{2 * j}"), F.col("g"))
            on = on & (2 * j < F.col("n")) & F.coalesce(rho > 0, F.lit(False))
            total = total + F.when(on, rho).otherwise(0.0)
        out = sums.withColumn("_open", on).withColumn("_t", total)
        flat = F.col("g") / F.col("n") < 1e-30
        ess = F.when(F.col("n") < 4, F.col("n").cast("double")).when(flat, 1.0).otherwise(F.greatest(F.col("n") / (1 + 2 * F.col("_t")), F.lit(1.0)))
        if out.where(F.col("_open") & (F.col("n") >= 4)).isEmpty():
            return out.select(*by, "n", ess.alias("ess"))
        pairs *= 2


def numerical_events(rows: DataFrame, by: list[str], numerator: str | None = None, denominator: str | None = None, logs: tuple[str, ...] = (), roots: tuple[str, ...] = (), results: tuple[str, ...] = ()) -> DataFrame:
    """How often arithmetic met an edge: divisions by 0, logs of what is not above 0, roots of negatives, results that aren't finite."""
    count = lambda c, name: F.count_if(c).alias(name)
    none = F.lit(False)
    either = lambda columns, test: sum((F.when(test(F.col(c)), 1).otherwise(0) for c in columns), F.lit(0))
    return rows.groupBy(*by).agg(
        count((F.col(denominator) == 0) if denominator else none, "div0"), count((F.col(denominator) == 0) & (F.col(numerator) == 0) if denominator and numerator else none, "zero_over_zero"),
        F.sum(either(logs, lambda c: c <= 0)).alias("log_domain"), F.sum(either(roots, lambda c: c < 0)).alias("sqrt_domain"), F.sum(either(results, lambda c: F.isnan(c) | (F.abs(c) == float("inf")))).alias("not_finite"),
    )
