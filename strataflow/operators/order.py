"""Order statistics of groups of any size.

Values are counted first, so that equal ones travel once.  One scan by range sums the counts in order of the value, so a group
with most of the rows is spread over many tasks, and its written result serves all that is read off it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.scan import scanned


def joined_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys in which null equals null; the right side's other columns are added."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def numbered_within(df: DataFrame, by: Sequence[str], order: str, number: str, size: str) -> DataFrame:
    """Adds each row's ``number`` in its group, from 1, and the group's ``size``."""
    placed = scanned(df.withColumn("_one", F.lit(1).cast("long")), by, [F.col(order).asc()], {number: ("sum", "_one")}).drop("_one")
    return joined_by(placed, placed.groupBy(*by).agg(F.count("*").alias(size)), by)


def ordered_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, also: Sequence[str] = (), kept: Column | None = None) -> DataFrame:
    """One row per distinct (by, also, value), with sums over the whole group ``by``:

    ``_c``: its rows (or weight), ``_all``: its rows with nulls counted, ``_upto``: what is at or below the value, ``_ties``:
    what has the value, ``_total``: all of the group.  A null value counts in ``_all`` alone, and so do rows that are not
    ``kept``; with ``kept``, ``_upto_all`` and ``_total_all`` are the sums over all rows with a value.  A value has as many
    rows as there are different ``also``.
    """
    live = F.col(value).isNotNull() if kept is None else F.col(value).isNotNull() & kept
    c = F.count(F.when(live, 1)) if weight is None else F.coalesce(F.sum(F.when(live, F.col(weight).cast("double"))), F.lit(0.0))
    rows = df.groupBy(*by, *also, value).agg(c.alias("_c"), F.count("*").alias("_all"))
    sums = {"": "_c"}
    if kept is not None:
        rows, sums = rows.withColumn("_every", F.when(F.col(value).isNotNull(), F.col("_all")).otherwise(F.lit(0).cast("long"))), sums | {"_all": "_every"}
    rows = scanned(rows, by, [F.col(value).asc_nulls_first()], {f"_upto{end}": ("sum", c) for end, c in sums.items()})
    totals = rows.groupBy(*by).agg(*[F.max(f"_upto{end}").alias(f"_total{end}") for end in sums])
    rows = rows.withColumn("_ties", F.col("_c"))
    if also:
        # Rows of one value stand in any order; the last of them has all.  Values with one row, mostly the most, need no second look.
        ends = {f"_upto{end}": F.max(f"_upto{end}").alias(f"_last{end}") for end in sums}
        shared = rows.groupBy(*by, value).agg(*ends.values(), F.sum("_c").alias("_sum"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
        rows = joined_by(rows, shared, [*by, value], "left")
        rows = rows.withColumns({f"_upto{end}": F.coalesce(f"_last{end}", f"_upto{end}") for end in sums} | {"_ties": F.coalesce("_sum", "_ties")}).drop("_sum", *[f"_last{end}" for end in sums])
    return joined_by(rows.drop("_every"), totals, by)


def interpolated(p: float, value: str, of: str = ""):
    """Aggregate over :func:`ordered_counts`: the quantile between the two values around the place (n - 1) p.

    ``of`` is ``_all`` for the quantile over all rows instead of those kept.
    """
    at = (F.col(f"_total{of}") - 1) * p
    pick = lambda k: F.min(F.when(F.col(f"_upto{of}") > k, F.col(value)))
    low, high, part = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
    return low + (high - low) * part
