"""Temporal reductions of series: one row per series, from one shuffle by series key.

A censored result (a crossing that never happens, a time outside the series) is missing, as is the extreme of a series
without a finite value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.functions.arithmetic import finite
from strataflow.operators.joins import as_of


def reductions(df: DataFrame, by: list[str], time: str, value: str, threshold: Column | float | None = None) -> DataFrame:
    """final, max, min, mean, time_of_max, time_of_min, integral and, with a threshold, counts and crossing times."""
    t, v = F.col(time), F.col(value).cast("double")
    good = F.when(finite(v), v)
    order = W.partitionBy(*by).orderBy(time)
    slab = 0.5 * (v + F.lead(v).over(order)) * (F.lead(t).over(order) - t)
    rows = df.withColumn("_slab", slab).withColumn("_good", good)
    at = lambda better: F.min(F.when(F.col("_good").isNotNull(), F.struct(better.alias("x"), t.alias("t"))))["t"]
    aggs = {
        "final": F.max_by(v, t), "max": F.max("_good"), "min": F.min("_good"), "mean": F.avg(v),
        "time_of_max": at(-F.col("_good")), "time_of_min": at(F.col("_good")), "integral": F.coalesce(F.sum("_slab"), F.lit(0.0)),
    }
    if threshold is not None:
        thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        both = finite(v) & finite(thr.cast("double"))
        for name, hit in (("above", both & (v > thr)), ("below", both & (v < thr))):
            aggs |= {f"count_{name}": F.count_if(hit), f"first_{name}": F.min(F.when(hit, t)), f"last_{name}": F.max(F.when(hit, t))}
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def value_at(df: DataFrame, by: list[str], time: str, value: str, at: float) -> DataFrame:
    """The last value at or before a time; missing outside the series."""
    t = F.col(time)
    row = F.max(F.when(t <= at, F.struct(t.alias("t"), F.col(value).alias("v"))))["v"]
    return df.groupBy(*by).agg(F.when(F.max(t) >= at, row).alias("value_at"))


def values_at(df: DataFrame, points: DataFrame, by: list[str], time: str, value: str, at: str) -> DataFrame:
    return as_of(points, df, by, at, time, value)


def derived(df: DataFrame, expressions: dict[str, Column], depends: dict[str, list[str]] | None = None) -> DataFrame:
    """Add derived quantities in order of dependence; a missing argument makes the result missing."""
    left, done = dict(expressions), set(df.columns)
    while left:
        ready = [n for n in left if set((depends or {}).get(n, [])) <= done]
        if not ready:
            raise ValueError(f"quantities depend on each other or on unknown names: {sorted(left)}")
        df = df.withColumns({n: left.pop(n) for n in ready})
        done |= set(ready)
    return df
