"""Views of the driver's tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, day (whole days since the epoch), ts."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.datediff("ts", F.lit(EPOCH).cast("date")).cast("long").alias("day"), F.col("ts").cast("timestamp").alias("ts"))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, ts FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, day, n, v: counts and rounded sums per day and type."""
    return events(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


DAILY = EVENTS + ", daily AS (SELECT event_type, day, count(*) AS n, round(sum(value), 4) AS v FROM ev GROUP BY event_type, day)"


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, price: order value per day, in whole units; days since 1992-01-01."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return o.groupBy(day.alias("day")).agg(F.sum(F.round(F.col("o_totalprice")).cast("long")).alias("price"))


REVENUE = "revenue AS (SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS price FROM orders GROUP BY 1)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded; NaN and infinities stay."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
