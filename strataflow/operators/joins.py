"""Join shapes: dense grids with defaults, as-of reads, tolerant and paired joins, shared axes, chain selection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import Refused, refuse_any
from strataflow.operators.scan import scanned


def levels(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(level, ord): distinct levels in order of first occurrence."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.min(row_id).alias("_first"))
    return first.select("level", (F.row_number().over(W.orderBy("_first")) - 1).alias("ord"))


def grid(*dims: DataFrame) -> DataFrame:
    """All combinations of small level tables."""
    return functools.reduce(lambda a, b: a.crossJoin(b), dims)


def with_default(cells: DataFrame, rows: DataFrame, keys: list[str], value: str, default: float | None = None) -> DataFrame:
    """Value of each cell; cells without a row get the default, and without a default they are refused."""
    if default is None:
        refuse_any(missing_cells(cells, rows, keys), "a dense table needs a row for each cell")
        return cells.join(rows, keys)
    return cells.join(rows, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def missing_cells(cells: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(rows, keys, "left_anti")


def unknown_levels(rows: DataFrame, dim: DataFrame, column: str) -> DataFrame:
    """Rows whose level is not in the dimension."""
    return rows.join(dim.select(F.col("level").alias(column)), column, "left_anti")


def pairs_where(dim: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """All ordered pairs of levels (``a``, ``b``), by default without self-loops."""
    a, b = dim.select(F.col(column).alias("a")), dim.select(F.col(column).alias("b"))
    return a.crossJoin(b).where(F.col("a") != F.col("b") if where is None else where)


def linked_pairs(dim: DataFrame, column: str, by: str) -> DataFrame:
    """Ordered pairs (``a``, ``b``) of different levels that agree in another column."""
    a, b = dim.select(F.col(column).alias("a"), F.col(by).alias("_by")), dim.select(F.col(column).alias("b"), F.col(by).alias("_by"))
    return a.join(b, "_by").where("a <> b").select("a", "b")


def consecutive(dim: DataFrame) -> DataFrame:
    """(level, next_level) along a dimension's order."""
    return dim.select("level", F.lead("level").over(W.orderBy("ord")).alias("next_level")).where("next_level is not null")


def as_of(points: DataFrame, series: DataFrame, by: list[str], at: str, time: str, value: str, censor_after_end: bool = True) -> DataFrame:
    """Adds ``value`` of the last series row at or before each point; missing before the first row and after the last.

    Both sides are merged and one scan carries the last value on, so there is no range join, and one key may hold most of the
    rows.  Of rows of one time the greatest value counts; a point without a time has none.
    """
    known = series.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("_t")).agg(F.max(value).alias("_v"))
    marks = known.select(*by, "_t", F.lit(0).alias("_k"), F.struct("_v", F.lit(False).alias("over")).alias("_s"))
    if censor_after_end:
        # What comes after the points of the last time ends the series.
        ends = known.groupBy(*by).agg(F.max("_t").alias("_t"))
        marks = marks.unionByName(ends.select(*by, "_t", F.lit(2).alias("_k"), F.struct(F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.lit(True).alias("over")).alias("_s")))
    return _read(points, marks, by, F.col(at), lambda s: F.when(~s["over"], s["_v"]), value)


def nearest(points: DataFrame, series: DataFrame, by: list[str], at: str, time: str, value: str) -> DataFrame:
    """Adds ``value`` of the nearest series row; of two as near, the earlier one.

    A row is the nearest one after the middle between it and the row before it.  Times are doubled, so that middles of whole
    numbers are whole numbers.
    """
    known = series.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("_t")).agg(F.max(value).alias("_v"))
    known = scanned(known, by, [F.col("_t").asc()], {"_prev": ("before", "_t")})
    marks = known.select(*by, (F.col("_prev") + F.col("_t")).alias("_t"), F.lit(1).alias("_k"), F.struct("_v").alias("_s"))
    return _read(points, marks, by, 2 * F.col(at), lambda s: s["_v"], value, point=0)


def _read(points: DataFrame, marks: DataFrame, by: list[str], at: Column, value, out: str, point: int = 1) -> DataFrame:
    """Points with what the last mark (by, _t, _k, _s) before them says; marks without a time are the first."""
    row = F.struct(*points.columns)
    asked = points.select(*by, at.alias("_t"), F.lit(point).alias("_k"), F.lit(None).cast(marks.schema["_s"].dataType).alias("_s"), row.alias("_row"))
    both = marks.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).select(asked.columns).unionByName(asked)
    both = scanned(both, by, [F.col("_t").asc_nulls_first(), F.col("_k").asc()], {"_open": ("last", "_s")}).where(F.col("_row").isNotNull())
    return both.select("_row.*", F.when(F.col("_t").isNotNull(), value(F.col("_open"))).alias(out))


def at_same_time(left: DataFrame, right: DataFrame, by: list[str], time: str, tolerance: float = 1e-9) -> DataFrame:
    """Inner join on times that differ by at most the tolerance: an equi-join on rounded times and their neighbours."""
    cell = F.round(F.col(time) / (2 * tolerance)).cast("long")
    a = left.withColumn("_c", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = right.withColumn("_c", cell).withColumnRenamed(time, "_right_time")
    return a.join(b, [*by, "_c"]).where(F.abs(F.col(time) - F.col("_right_time")) <= tolerance).drop("_c", "_right_time")


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, a, b, delta) of rows on both sides; refused where one side has keys that the other has not."""
    a, b = left.select(*keys, F.col(value).alias("a")), right.select(*keys, F.col(value).alias("b"))
    lone = a.join(b, keys, "full_outer").where("a is null or b is null")
    refuse_any(lone, "the two sides have different keys")
    return a.join(b, keys).withColumn("delta", F.col("b") - F.col("a"))


def paired_outer(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer pairing; a missing side stays missing."""
    a, b = left.select(*keys, F.col(value).alias("a")), right.select(*keys, F.col(value).alias("b"))
    return a.join(b, keys, "full_outer")


def shared_axis(streams: dict[str, DataFrame], by: list[str], time: str, value: str) -> DataFrame:
    """All streams on the union of their times; a stream without a row at a time is missing there.

    One aggregation instead of a chain of joins.
    """
    rows = [df.select(*by, time, F.lit(name).alias("_stream"), F.col(value).alias("_v")) for name, df in streams.items()]
    merged = functools.reduce(DataFrame.unionByName, rows)
    return merged.groupBy(*by, time).agg(*[F.max(F.when(F.col("_stream") == name, F.col("_v"))).alias(name) for name in streams])


def select_chains(df: DataFrame, keep: list[int] | None = None, drop: list[int] | None = None, chain: str = "chain") -> DataFrame:
    """Rows of the selected chains; both or neither selection, unknown chains and an empty result are refused."""
    if (keep is None) == (drop is None):
        raise Refused("give either chains to keep or chains to drop")
    asked = set(keep if keep is not None else drop)
    # Only chains that were asked for come to the driver; rows of other chains are told apart by the filter alone.
    hit = F.col(chain).isin(*asked) if asked else F.lit(False)
    known = {r[0] for r in df.where(hit).select(chain).distinct().collect()}
    if asked - known:
        raise Refused(f"no such chains: {sorted(asked - known)}")
    left = df.where(hit if keep is not None else ~F.coalesce(hit, F.lit(False)))
    if left.isEmpty():
        raise Refused("no chain is left")
    return left


def seed_pairs(runs: DataFrame, scenario: str, base: str, other: str, keys: list[str], value: str) -> DataFrame:
    """Differences between two scenarios of the same seed and point; one aggregation, no self-join."""
    side = lambda s: F.max(F.when(F.col(scenario) == s, F.col(value)))
    both = runs.where(F.col(scenario).isin(base, other)).groupBy(*keys).agg(side(base).alias("a"), side(other).alias("b"))
    return both.where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def parent_edges(rows: DataFrame, child: str, parent: str, time: str) -> DataFrame:
    """(child, parent, time) of the first row of each child."""
    first = rows.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("child")).agg(F.min(F.struct(F.col(time).alias("time"), F.col(parent).alias("parent"))).alias("f"))
    return first.select("child", "f.parent", "f.time")
