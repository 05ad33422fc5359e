"""Posterior prediction: draws are cells of a run, their paths are observed, and bands are taken over draws.

free_forward starts every draw from the model's initial values, one_step goes from each stored state to the next observation,
forecast goes on from the states at the end of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.checks import Refused, refuse_any
from strataflow.functions import expr as X
from strataflow.operators import bands
from strataflow.plans import simulate
from strataflow.plans.model import Model

KEYS = ["chain", "draw"]


def free_forward(draws: DataFrame, model: Model, start: float, stop: float, dt: float, every: int) -> DataFrame:
    """Paths of every draw (chain, draw, seed, parameters) from the model's initial values."""
    return simulate.chain_binomial(draws, model, start, stop, dt, every)


def forecast(draws: DataFrame, states: DataFrame, model: Model, at: float, stop: float, dt: float, every: int) -> DataFrame:
    """Paths of every draw from its own state at the end of the data; the first row, at ``at``, is left out."""
    cells, go_on = simulate.resume(draws, states, KEYS, model, at)
    return simulate.chain_binomial(cells, go_on, at, stop, dt, every).where(F.col("time") > at).drop(*[f"from_{c}" for c in model.compartments])


def one_step(draws: DataFrame, states: DataFrame, model: Model, period: float, dt: float) -> DataFrame:
    """One period from every stored state (chain, draw, time, compartments): a prediction for each state's next observation.

    Periods all run from 0, so rates must not depend on time.
    """
    if any("t" in X.references(e) for e in [*(t.rate for t in model.transitions), *model.bindings.values()]):
        raise Refused("one-step predictions need rates without time")
    refuse_any(states.join(draws.select(*KEYS), KEYS, "left_anti"), "a state has no draw")
    cells = draws.join(states.select(*KEYS, F.col("time").alias("state_time"), *model.compartments), KEYS).withColumn("seed", F.xxhash64("seed", "state_time").bitwiseAND(F.lit(2**62 - 1)))
    ends = cells.select(*KEYS, "state_time", F.lit(0.0).alias("time"), *model.compartments)
    cells, go_on = simulate.resume(cells.drop(*model.compartments), ends, [*KEYS, "state_time"], model, 0.0)
    steps = simulate.n_substeps(0.0, period, dt)
    path = simulate.chain_binomial(cells, go_on, 0.0, period, dt, steps).where(F.col("time") > 0)
    return path.withColumn("time", F.col("state_time") + period).drop(*[f"from_{c}" for c in model.compartments], "state_time")


def predictive_bands(paths: DataFrame, flow: str, family: str, reporting: float, dispersion: float = 0.0, by: tuple[str, ...] = ("time",)) -> DataFrame:
    """Quantiles over draws of the synthetic observations of a flow."""
    return bands.band(simulate.observe(paths, flow, family, reporting, dispersion), list(by), "observed")


def paired_with_data(predicted: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted and observed rows that share time and strata."""
    return predicted.join(observed, keys)
