"""Sums of products of a series with itself some places before, for series of any length.

Rows are numbered in order by a scan and cut into blocks; the last rows of a block also go to the next one, as its halo.  Lags
are then read inside a block, so one long series is spread over its blocks, and each row travels at most twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.operators.order import joined_by, numbered_within

#: Rows of a block, where the lags don't ask for more.
BLOCK = 4096


def centred(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, value, _i, _n, _d): number in the series, its length, and the value less the series' mean; null for a null value."""
    rows = numbered_within(df.select(*by, order, F.col(value).alias("_v")), by, order, "_i", "_n")
    return joined_by(rows, rows.groupBy(*by).agg(F.avg("_v").alias("_m")), by).select(*by, F.col("_v").alias(value), "_i", "_n", (F.col("_v") - F.col("_m")).alias("_d"))


def lag_products(rows: DataFrame, by: Sequence[str], value: str, lags: int, block: int = BLOCK) -> DataFrame:
    """One row per series of :func:`centred`: n, total, g0 and g1 .. g<lags>, the sums of d(i) d(i - k); a product with a null, or
    with what lies before the beginning, is left out, and a sum without products is null."""
    size = max(block, lags)
    own, place = F.floor((F.col("_i") - 1) / size), (F.col("_i") - 1) % size
    both = rows.withColumn("_own", own).withColumn("_b", F.explode(F.when(place >= size - lags, F.array(own, own + 1)).otherwise(F.array(own))))
    at = W.partitionBy(*by, "_b").orderBy("_i")
    both = both.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(at) for k in range(1, lags + 1)}).where(F.col("_b") == F.col("_own"))
    products = [F.sum(f"_p{k}").alias(f"g{k}") for k in range(1, lags + 1)]
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col("_d") * F.col("_d")).alias("g0"), *products)
