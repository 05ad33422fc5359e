"""Row windows, interval sums, cohorts and trailing windows.  Windows are half-open: start <= t < stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.operators.order import numbered_within
from strataflow.operators.scan import scanned

FORMS = ("day", "starting_on", "ending_on", "closing_at")


def label_window(df: DataFrame, label: str, form: str, width: float = 1.0, day: float = 1.0) -> DataFrame:
    """Adds ``start`` and ``stop`` of the window that a row's time label covers."""
    t = F.col(label)
    bounds = {"day": (t, t + day), "starting_on": (t, t + width), "ending_on": (t + day - width, t + day), "closing_at": (t - width, t)}
    if form not in bounds:
        raise ValueError(f"form must be one of {FORMS}")
    start, stop = bounds[form]
    return df.withColumn("start", start).withColumn("stop", stop)


def window_violations(windows: DataFrame, by: list[str], uniform: bool = False, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows that overlap the row before them (``overlap``) or, for uniform forms, leave a gap to it (``gap``)."""
    before = F.lag(stop).over(W.partitionBy(*by).orderBy(start, stop))
    kind = F.when(F.col(stop) <= F.col(start), "empty").when(before > F.col(start), "overlap")
    if uniform:
        kind = kind.when(before < F.col(start), "gap")
    return windows.withColumn("violation", kind).where("violation is not null")


def window_sums(flows: DataFrame, windows: DataFrame, by: list[str], time: str, sums: dict[str, Column], bucket: float) -> DataFrame:
    """Aggregates of flows over each window; windows without flows keep a row with nulls.

    Both sides meet on (stratum, time bucket), an equi-join whose buckets should be about as wide as a window.  Flows are
    pre-aggregated by the join's map side only if the caller does so; every flow is joined to the windows that hold it.
    """
    rows = windows.select(*by, "start", "stop").distinct()
    last = F.ceil(F.col("stop") / bucket).cast("long") - 1
    spread = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket).cast("long"), F.greatest(last, F.floor(F.col("start") / bucket).cast("long")))))
    spread = spread.select(*[F.col(c).alias(f"_w_{c}") for c in by], F.col("start").alias("_start"), F.col("stop").alias("_stop"), "_b")
    cut = flows.withColumn("_fb", F.floor(F.col(time) / bucket).cast("long"))
    on = [F.col("_fb") == F.col("_b")] + [cut[c] == F.col(f"_w_{c}") for c in by]
    joined = cut.join(spread, on).where((F.col(time) >= F.col("_start")) & (F.col(time) < F.col("_stop")))
    found = joined.groupBy(*[F.col(f"_w_{c}").alias(f"_w_{c}") for c in by], "_start", "_stop").agg(*[c.alias(n) for n, c in sums.items()])
    on = [rows[c] == found[f"_w_{c}"] for c in by] + [rows["start"] == found["_start"], rows["stop"] == found["_stop"]]
    return rows.join(found, on, "left").select(*[rows[c] for c in by], "start", "stop", *sums)


def interval_sums(flows: DataFrame, windows: DataFrame, by: list[str], time: str, values: dict[str, str], count: str = "n") -> DataFrame:
    """Number of flows and sums of their values over each window, by two reads of running sums, whatever a window's width.

    Flows are summed per time first; then flows and window bounds are merged in time order, and one scan gives the sum of all
    flows before each bound.  Windows without flows have the count 0, and a sum without values is null.  Sums of whole numbers
    are exact; those of doubles are off by rounding of the running sum.
    """
    names = list(values)
    kind = {out: "long" if flows.schema[column].dataType.typeName() in ("byte", "short", "integer", "long") else "double" for out, column in values.items()}
    sums = [x for out in names for x in (F.sum(F.col(values[out]).cast(kind[out])).alias(f"_v_{out}"), F.count(values[out]).alias(f"_c_{out}"))]
    cells = flows.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("_t")).agg(F.count("*").alias("_c"), *sums)
    added = [c for c in cells.columns if c.startswith(("_v_", "_c_"))] + ["_c"]
    rows = windows.select(*by, "start", "stop").distinct()
    bound = F.explode(F.array(F.struct(F.col("start").alias("_t"), F.lit(-1).alias("_sign")), F.struct(F.col("stop").alias("_t"), F.lit(1).alias("_sign"))))
    bounds = rows.select(*by, "start", "stop", bound.alias("_b")).select(*by, "start", "stop", "_b._t", "_b._sign", *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in added])
    cells = cells.select(*by, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("start", "stop")], "_t", F.lit(None).cast("int").alias("_sign"), *added)
    # At one time, bounds come before flows: a window holds its start and not its stop.
    order = [F.col("_t").asc(), F.col("_sign").isNull().asc()]
    upto = scanned(bounds.unionByName(cells), by, order, {f"_s{c}": ("sum", c) for c in added}).where(F.col("_sign").isNotNull())
    found = upto.groupBy(*by, "start", "stop").agg(*[F.sum(F.col("_sign") * F.col(f"_s{c}")).alias(c) for c in added])
    return found.select(*by, "start", "stop", F.col("_c").alias(count), *[F.when(F.col(f"_c_{out}") > 0, F.col(f"_v_{out}")).alias(out) for out in names])


def ratio(a: Column, b: Column) -> Column:
    """Ratio of two sums; missing where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def holes(df: DataFrame, score: str, aux: list[str]) -> DataFrame:
    """Where the score or an auxiliary column is missing, the row becomes a hole: it keeps its window and has no values."""
    missing = F.col(score).isNull()
    for c in aux:
        missing = missing | F.col(c).isNull()
    out = df.withColumn("_hole", missing)
    for c in (score, *aux):
        out = out.withColumn(c, F.when(~F.col("_hole"), F.col(c)))
    return out.withColumnRenamed("_hole", "is_hole")


def cohort_bins(df: DataFrame, by: list[str], time: str, width: float, from_zero: bool = False) -> DataFrame:
    """(bin, lo, hi, n, cumulative) from the first event (or 0); the last bin holds the largest time; empty bins appear."""
    t = F.col(time).cast("double")
    span = df.groupBy(*by).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    span = span.withColumn("_lo", F.lit(0.0) if from_zero else F.col("_first"))
    bins = F.greatest(F.ceil((F.col("_last") - F.col("_lo")) / width), F.lit(1)).cast("long")
    span = span.withColumn("_bins", bins)
    keys = [F.col(c).alias(f"_s_{c}") for c in by]
    on = [df[c].eqNullSafe(F.col(f"_s_{c}")) for c in by] or [F.lit(True)]
    placed = df.join(F.broadcast(span.select(*keys, "_lo", "_bins")) if not by else span.select(*keys, "_lo", "_bins"), on)
    number = F.least(F.floor((t - F.col("_lo")) / width).cast("long"), F.col("_bins") - 1)
    counts = placed.withColumn("bin", number).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = span.select(*by, "_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)).alias("bin"))
    out = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    running = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    lo = F.col("_lo") + F.col("bin") * width
    return out.select(*by, "bin", lo.alias("lo"), (lo + width).alias("hi"), "n", F.sum("n").over(running).alias("cumulative"))


def trailing(df: DataFrame, by: list[str], tick: str, width: int, value: str) -> DataFrame:
    """Sum, mean, max and latest over (now - width, now]; ``tick`` is a whole number.  A window without values gives 0.

    Series are cut into blocks of ``width`` ticks, and every row goes to its own block and, for the windows that reach back, to
    the next one.  So one long series is spread over its blocks.
    """
    block = F.floor(F.col(tick) / width)
    both = df.withColumn("_block", F.explode(F.array(block, block + 1)))
    w = W.partitionBy(*by, "_block").orderBy(tick).rangeBetween(-width + 1, 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = both.withColumns({"w_sum": zero(F.sum(value).over(w)), "w_mean": zero(F.avg(value).over(w)), "w_max": zero(F.max(value).over(w)), "w_latest": zero(F.last(value, ignorenulls=True).over(w))})
    return out.where(F.col("_block") == block).drop("_block")


def tenths(df: DataFrame, by: list[str], order: str, parts: int = 10) -> DataFrame:
    """Adds ``part``: the tenth of its series that a row lies in, by position."""
    placed = numbered_within(df, by, order, "_i", "_all")
    return placed.select(*df.columns, F.floor(parts * (F.col("_i") - 1) / F.col("_all")).cast("int").alias("part"))


def emission_times(cells: DataFrame, start: str, stop: str, every: float) -> DataFrame:
    """One row per regular emission time in (start, stop]."""
    n = F.floor((F.col(stop) - F.col(start)) / every).cast("long")
    times = F.when(n >= 1, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda k: F.col(start) + k * every))
    return cells.withColumn("time", F.explode(times))
