"""Priors of two levels over customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions.density import prior_given
from strataflow.operators.hierarchy import level_log_prior
from strataflow.queries import query
from strataflow.queries.base import rounded, table


@query(
    "hierarchical_log_prior",
    """WITH a AS (SELECT n_nationkey, n_nationkey / 10.0 - 1 AS mu, 0.5 + n_regionkey AS sd FROM nation), u AS (SELECT c_nationkey AS n_nationkey, CAST(c_acctbal AS DOUBLE) / 1000 AS x FROM customer)
    SELECT n_nationkey, count(x) AS units, round(coalesce(sum(-0.5 * ((x - mu) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi())), 0), 4) AS log_prior,
    round(any_value(-0.5 * (mu / 2) ** 2 - ln(2) - 0.5 * ln(2 * pi()) + ln(1.5) - 1.5 * sd) + coalesce(sum(-0.5 * ((x - mu) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi())), 0), 4) AS joint FROM a LEFT JOIN u USING (n_nationkey) GROUP BY n_nationkey""",
)
def hierarchical_log_prior(spark, sf_dir):
    """Balances of customers drawn around their nation's mean with its spread, which have priors themselves."""
    above = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 10.0 - 1).alias("mu"), (F.col("n_regionkey") + 0.5).cast("double").alias("sd"))
    units = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_acctbal").cast("double") / 1000).alias("x"))
    own = prior_given(F.col("mu"), "normal", F.lit(0.0), F.lit(2.0)) + prior_given(F.col("sd"), "exponential", F.lit(1.5))
    levels = level_log_prior(units, above, "n_nationkey", "x", "normal", ["mu", "sd"]).join(above, "n_nationkey")
    return rounded(levels.select("n_nationkey", "units", "log_prior", (F.col("log_prior") + own).alias("joint")), 4)
