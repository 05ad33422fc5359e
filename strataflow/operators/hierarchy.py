"""Log priors over levels: what a unit draws from depends on the unit above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.checks import refuse_any
from strataflow.functions.density import prior_given


def level_log_prior(units: DataFrame, above: DataFrame, key: str, value: str, family: str, args: list[str], out: str = "log_prior") -> DataFrame:
    """One row per unit above: ``key``, ``units`` and the sum of the log priors of its units, whose arguments are columns of ``above``.

    A unit above without units sums to 0; a null value or argument makes the sum null.  Units without one above, and a unit above that
    is there twice, are refused.  Units are joined by key and summed map-side, so that one above may have most of them.
    """
    known = above.select(F.col(key).alias("_key"), *[F.col(a).alias(f"_a{i}") for i, a in enumerate(args)])
    refuse_any(known.groupBy("_key").count().where("count > 1"), f"{key} is there twice")
    refuse_any(units.select(key).join(known, units[key] == known["_key"], "left_anti"), f"units without a {key}")
    each = known.join(units.select(F.col(key).alias("_unit"), F.col(value).alias("_x")), F.col("_key") == F.col("_unit"), "left")
    scored = each.withColumn("_l", prior_given(F.col("_x"), family, *[F.col(f"_a{i}") for i in range(len(args))]))
    nulls = F.col("_unit").isNotNull() & F.greatest(F.col("_x").isNull(), *[F.col(f"_a{i}").isNull() for i in range(len(args))])
    total = F.when(F.max(nulls), F.lit(None)).otherwise(F.coalesce(F.sum(F.when(F.col("_unit").isNotNull(), F.col("_l"))), F.lit(0.0)))
    return scored.groupBy(F.col("_key").alias(key)).agg(F.count("_unit").alias("units"), total.alias(out))
