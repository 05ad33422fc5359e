"""Scoring rules, comparison tables, hold-out splits and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import refuse_any
from strataflow.operators.bands import log_mean_exp, replicate_totals
from strataflow.operators.diagnostics import DECIBANS, evidence_label, newey_west


def scored(rows: DataFrame, observed: str) -> DataFrame:
    """Rows that give a score: holes don't."""
    return rows.where(F.col(observed).isNotNull())


def step_log_score(particles: DataFrame, step: list[str], loglik: str) -> DataFrame:
    """Log of the mean likelihood over particles at each step."""
    return log_mean_exp(particles, step, loglik).select(*step, F.col("log_mean").alias("log_score"))


def fair_crps(samples: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """mean |x - y| less the mean absolute difference of two distinct samples, from one sort: no pairs are made."""
    g = W.partitionBy(*by)
    rows = samples.withColumn("_i", F.row_number().over(g.orderBy(x))).withColumn("_s", F.count("*").over(g))
    spread = F.sum((2 * F.col("_i") - F.col("_s") - 1) * F.col(x))
    n = F.max("_s")
    out = rows.groupBy(*by).agg(n.alias("n_samples"), (F.avg(F.abs(F.col(x) - F.col(y))) - F.when(n > 1, F.try_divide(spread, n * (n - 1))).otherwise(0.0)).alias("crps"))
    return out


def randomised_pit(samples: DataFrame, by: list[str], x: str, y: str, v: Column | None = None) -> DataFrame:
    """P(X < y) + v P(X = y); v is uniform from a hash of the key, so it doesn't depend on partitions."""
    share = lambda c: F.avg(c.cast("double"))
    u = F.pmod(F.xxhash64(*by), F.lit(2**31)) / 2.0**31 if v is None else v
    out = samples.groupBy(*by).agg(share(F.col(x) < F.col(y)).alias("_below"), share(F.col(x) == F.col(y)).alias("_at"))
    return out.select(*by, (F.col("_below") + u * F.col("_at")).alias("pit"))


def coverage(pits: DataFrame, by: list[str], pit: str = "pit", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    return pits.groupBy(*by).agg(F.avg(F.col(pit).between(lo, hi).cast("double")).alias("coverage"), F.count("*").alias("n"))


def preflight(a: DataFrame, b: DataFrame, keys: list[str], observed: str) -> DataFrame:
    """Differences that forbid a comparison: keys on one side only, or other observed values."""
    x, y = a.select(*keys, F.col(observed).alias("ya")), b.select(*keys, F.col(observed).alias("yb"))
    both = x.withColumn("_a", F.lit(True)).join(y.withColumn("_b", F.lit(True)), keys, "full_outer")
    why = F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").when(~F.col("ya").eqNullSafe(F.col("yb")), "other data")
    return both.withColumn("problem", why).where("problem is not null").select(*keys, "problem")


def compare(base: DataFrame, other: DataFrame, by: list[str], time: str, score: str, check: bool = True) -> DataFrame:
    """elpd of both, its difference, Newey-West error, decibans and label, per group (streams are never summed)."""
    a, b = base.select(*by, time, F.col(score).alias("a")), other.select(*by, time, F.col(score).alias("b"))
    if check:
        refuse_any(a.join(b, [*by, time], "full_outer").where("a is null or b is null"), "the models scored different times")
    both = a.join(b, [*by, time]).withColumn("d", F.col("b") - F.col("a"))
    nw = newey_west(both, by, time, "d")
    sums = both.groupBy(*by).agg(F.sum("a").alias("elpd_base"), F.sum("b").alias("elpd"))
    se = F.col("nw_se") / F.col("small_sample")
    out = (sums.join(nw, by) if by else sums.crossJoin(F.broadcast(nw)))
    return out.select(*by, "n", "elpd_base", "elpd", F.col("total").alias("delta_elpd"), se.alias("se_delta"), (F.col("total") * DECIBANS).alias("decibans"), "lag1", evidence_label(F.col("total"), se).alias("evidence"))


def replicate_elpd(scores: DataFrame, by: list[str], replicate: str, score: str) -> DataFrame:
    return replicate_totals(scores, by, replicate, score)


def split_at(rows: DataFrame, by: list[str], stop: str, cutoff: float, check: bool = True) -> DataFrame:
    """Adds ``role``: rows whose window ends by the cutoff train; they must come before all others."""
    out = rows.withColumn("role", F.when(F.col(stop) <= cutoff, "trained").otherwise("held_out"))
    if check:
        bad = out.withColumn("_seen", F.max(F.when(F.col("role") == "held_out", 1)).over(W.partitionBy(*by).orderBy("start", stop))).where("role = 'trained' and _seen = 1")
        refuse_any(bad, "a training row lies behind a held-out row")
    return out


def row_digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A digest per group that doesn't depend on the order of its rows."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.md5(F.concat_ws(",", F.array_sort(F.collect_list(text)))).alias("digest"))


def roles(rows: DataFrame, time: str, cutoff: float, observed: str) -> DataFrame:
    """trained, held_out or future."""
    return rows.withColumn("role", F.when(F.col(observed).isNull(), "future").when(F.col(time) <= cutoff, "trained").otherwise("held_out"))


def surprises(scores: DataFrame, score: str, k: int = 5) -> DataFrame:
    """The k worst scored rows (a top-k report)."""
    return scores.where(F.col(score).isNotNull()).orderBy(score, *[c for c in scores.columns if c != score]).limit(k)


def forecast_targets(streams: DataFrame, origin: float, horizon: float) -> DataFrame:
    """(stream, t_start, t_stop, horizon, lead) of each whole period after the origin, from rows (stream, period)."""
    n = F.floor(F.lit(horizon) / F.col("period")).cast("int")
    out = streams.where(n >= 1).withColumn("lead", F.explode(F.sequence(F.lit(1), n)))
    stop = origin + F.col("lead") * F.col("period")
    return out.select("stream", (stop - F.col("period")).alias("t_start"), stop.alias("t_stop"), (stop - origin).alias("horizon"), "lead")


def marginal_forecast_score(draws: DataFrame, target: list[str], log_density: str) -> DataFrame:
    return log_mean_exp(draws, target, log_density).select(*target, F.col("log_mean").alias("log_score"), F.col("log_mean_se").alias("se"))


def joint_forecast_score(draws: DataFrame, by: list[str], draw: list[str], log_density: str) -> DataFrame:
    """Densities are summed over targets within a draw, then averaged over draws."""
    return log_mean_exp(draws.groupBy(*by, *draw).agg(F.sum(log_density).alias("_l")), by, "_l").select(*by, F.col("log_mean").alias("log_score"), F.col("log_mean_se").alias("se"))


def overlapping_targets(targets: DataFrame) -> DataFrame:
    """Targets of a stream that begin before the one before them has ended."""
    before = F.max("t_stop").over(W.partitionBy("stream").orderBy("t_start", "t_stop").rowsBetween(W.unboundedPreceding, -1))
    return targets.withColumn("_b", before).where(F.col("_b") > F.col("t_start")).drop("_b")


def refuse_held_out_overlap(training: DataFrame, held_out: DataFrame) -> None:
    """Held-out periods (stream, t_start, t_stop) must not begin before the training data of their stream end."""
    ends = training.groupBy("stream").agg(F.max("t_stop").alias("_end"))
    refuse_any(held_out.join(ends, "stream").where(F.col("t_start") < F.col("_end")), "a held-out period overlaps the training data")


def arm_contrasts(samples: DataFrame, arm: str, base: str, draw: list[str], target: list[str], value: str) -> DataFrame:
    """(arm, target, n_draws, mean, quantiles) of each arm less the base arm, paired within draws."""
    from strataflow.operators.bands import band

    b = samples.where(F.col(arm) == base).select(*draw, *target, F.col(value).alias("_base"))
    delta = samples.where(F.col(arm) != base).join(b, [*draw, *target]).withColumn("delta", F.col(value) - F.col("_base"))
    mean = delta.groupBy(arm, *target).agg(F.avg("delta").alias("mean"))
    return band(delta, [arm, *target], "delta").join(mean, [arm, *target])


def run_arithmetic(runs: DataFrame, scenario: str, keys: list[str], value: str, terms: dict[str, dict[str, float]]) -> DataFrame:
    """Named sums over runs, e.g. {"averted": {"base": 1, "campaign": -1}}: one column each, missing where an operand is."""
    names = sorted({s for t in terms.values() for s in t})
    sides = {s: F.max(F.when(F.col(scenario) == s, F.col(value))) for s in names}
    out = runs.where(F.col(scenario).isin(names)).groupBy(*keys).agg(*[c.alias(f"_r_{s}") for s, c in sides.items()])
    total = lambda t: sum((F.col(f"_r_{s}") * k for s, k in t.items()), F.lit(0.0))
    return out.select(*keys, *[total(t).alias(n) for n, t in terms.items()])


def scenario_contrast(runs: DataFrame, scenario: str, left: str, right: str, keys: list[str], time: str, value: str, fork: float | None = None) -> DataFrame:
    """right - left of the final value per shared key, and the shared value at the last snapshot before the fork."""
    side = lambda s, c: F.max_by(F.when(F.col(scenario) == s, F.col(value)), F.when((F.col(scenario) == s) & c, F.col(time)))
    always = F.lit(True)
    rows = runs.where(F.col(scenario).isin(left, right))
    aggs = [side(left, always).alias("a"), side(right, always).alias("b")]
    if fork is not None:
        aggs.append(side(left, F.col(time) < fork).alias("at_fork"))
    return rows.groupBy(*keys).agg(*aggs).where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))
