"""Maximum likelihood by Newton steps over all rows, for every stratum at once.

A round is one aggregation: each row adds its log density, its part of the gradient and of the observed information, map-side
first, whatever the number of rows of a stratum.  What is left is one row per stratum, whose small system is solved in its arrays.
A step that lowers the likelihood is halved until it does not.  Rounds are written to the shared folder; the driver sees whether
strata are left, nothing else.  No row leaves the JVM and none is copied: every round reads the columns that it needs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions import density, gradient
from strataflow.operators.scratch import cut
from strataflow.operators.smoothing import _solved

#: Log density and derivatives by the mean, of (value, mean, what is fixed).
FAMILIES: dict[str, tuple[Callable[..., Column], Callable[..., gradient.Pair], str | None]] = {
    "poisson": (density.poisson, gradient.poisson, None),
    "negative_binomial": (density.negative_binomial, gradient.negative_binomial_mean, "size"),
    "normal": (density.normal, gradient.normal_mean, "sd"),
    "bernoulli": (density.bernoulli, gradient.bernoulli, None),
    "binomial": (lambda y, p, n: density.binomial(y, n, p), lambda y, p, n: gradient.binomial(y, n, p), "trials"),
    "beta": (density.beta, gradient.beta_mean, "concentration"),
}
LINKS = {
    "identity": (lambda e: (e, F.lit(1.0), F.lit(0.0)), lambda m: m),
    "log": (lambda e: (F.exp(e), F.exp(e), F.exp(e)), lambda m: F.log(m)),
    "logit": (lambda e: _logistic(1 / (1 + F.exp(-e))), lambda m: F.log(m / (1 - m))),
}


def _logistic(u: Column) -> tuple[Column, Column, Column]:
    return u, u * (1 - u), u * (1 - u) * (1 - 2 * u)


def _with_state(rows: DataFrame, state: DataFrame, by: list[str], c: str) -> DataFrame:
    """Rows of strata that are not done, with their coefficients ``_c``."""
    open_ = state.where(~F.col("done")).select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col(c).alias("_c"))
    if not by:
        # One stratum: a few numbers, which the plan may hold.
        first = open_.first()
        return rows.withColumn("_c", F.array(*[F.lit(float(x)) for x in first["_c"]]))
    same = functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(open_[f"_k_{k}"]) for k in by])
    return rows.join(open_, same).drop(*[f"_k_{k}" for k in by])


def fit_newton(df: DataFrame, by: list[str], value: str, terms: list[str], family: str, link: str, fixed: float | str | None = None, tolerance: float = 1e-10, max_rounds: int = 60) -> DataFrame:
    """One row per stratum: ``n``, ``coefficients`` (the constant first, then one for each term), ``gradient`` there,
    ``log_likelihood``, ``rounds`` and ``converged``.

    ``fixed`` is the family's size, spread, trials or concentration: a number, or a column's name.  Rows with a null value, term or
    fixed column are left out.  A stratum with a value that the family can't have, or whose terms don't determine the coefficients,
    is not converged and has null coefficients.
    """
    if family not in FAMILIES or link not in LINKS:
        raise Refused(f"no family {family} with link {link}")
    log_density, derivatives, wants = FAMILIES[family]
    if (wants is None) != (fixed is None):
        raise Refused(f"{family} wants {wants or 'nothing'} as fixed")
    mean_of, link_of = LINKS[link]
    size = len(terms) + 1
    extra = [] if fixed is None else [F.col(fixed).cast("double") if isinstance(fixed, str) else F.lit(float(fixed))]
    rows = df.select(*by, F.col(value).cast("double").alias("_y"), *[F.col(t).cast("double").alias(f"_x{j}") for j, t in enumerate(terms, 1)], *[e.alias("_f") for e in extra])
    rows = rows.dropna(subset=[c for c in rows.columns if c not in by]).withColumn("_x0", F.lit(1.0))
    none, few = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    # The start: a constant that gives the mean of the values (of their shares, for trials).
    share = F.sum("_y") / F.sum("_f") if family == "binomial" else F.avg("_y")
    start = rows.groupBy(*by).agg(F.count("*").alias("n"), link_of(share).alias("_s"))
    if not by:
        start = start.where("n > 0")
    state = cut(start.select(*by, "n", F.array(F.col("_s"), *[F.lit(0.0)] * (size - 1)).alias("c"), few.alias("base"), none.alias("ll"), few.alias("g"), few.alias("step"), F.lit(0).alias("rounds"), F.lit(False).alias("done"), F.lit(False).alias("converged")))

    for _ in range(max_rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        at = _with_state(rows, state, by, "c")
        eta = sum((F.get("_c", F.lit(j)) * F.col(f"_x{j}") for j in range(1, size)), F.get("_c", F.lit(0)))
        at = at.withColumn("_eta", eta)
        m, slope, bend = mean_of(F.col("_eta"))
        at = at.withColumns({"_m": m, "_m1": slope, "_m2": bend})
        held = ["_f"] if extra else []
        d1, d2 = derivatives(F.col("_y"), F.col("_m"), *map(F.col, held))
        at = at.withColumns({"_l": log_density(F.col("_y"), F.col("_m"), *map(F.col, held)), "_d1": d1, "_d2": d2})
        at = at.withColumns({"_g": F.col("_d1") * F.col("_m1"), "_h": -(F.col("_d2") * F.col("_m1") * F.col("_m1") + F.col("_d1") * F.col("_m2"))})
        x = [F.col(f"_x{j}") for j in range(size)]
        sums = [F.sum("_l").alias("_ll"), *[F.sum(F.col("_g") * x[j]).alias(f"_g{j}") for j in range(size)]]
        sums += [F.sum(F.col("_h") * x[i] * x[j]).alias(f"_h{i}_{j}") for i in range(size) for j in range(i, size)]
        found = at.groupBy(*by).agg(*sums)
        # A full symmetric system is a band as wide as itself.
        width = max(1, size - 1)
        entry = lambda i, d: F.col(f"_h{i}_{i + d}") if i + d < size else F.lit(0.0)
        band = F.array(*[F.struct(F.array(*[entry(i, d) for d in range(width + 1)]).alias("a"), F.col(f"_g{i}").alias("y")) for i in range(size)])
        found = found.withColumn("_band", band).select(*[F.col(k).alias(f"_k_{k}") for k in by], "_ll", F.array(*[F.col(f"_g{j}") for j in range(size)]).alias("_grad"), _solved(F.col("_band"), width).alias("_step"))
        same = functools.reduce(lambda a, b: a & b, [state[k].eqNullSafe(found[f"_k_{k}"]) for k in by], F.lit(True))
        open_ = state.where(~F.col("done")).join(found, same, "left").drop(*[f"_k_{k}" for k in by])
        state = cut(_moved(open_, tolerance).unionByName(state.where("done")))
    good = F.col("converged")
    return state.select(*by, "n", F.when(good, F.col("base")).alias("coefficients"), F.when(good, F.col("g")).alias("gradient"), F.when(good, F.col("ll")).alias("log_likelihood"), F.col("rounds").cast("long").alias("rounds"), "converged")


def _moved(open_: DataFrame, tolerance: float) -> DataFrame:
    """The next state of strata whose likelihood, gradient and step at ``c`` are known."""
    plus = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    usable = F.col("_ll").isNotNull() & ~F.isnan("_ll") & (F.abs("_ll") != float("inf"))
    # Rounding of the sum is no loss.
    better = usable & (F.col("ll").isNull() | (F.col("_ll") >= F.col("ll") - 1e-12 * F.abs("ll")))
    open_ = open_.withColumn("_better", better)
    base, step = F.when(F.col("_better"), F.col("c")).otherwise(F.col("base")), F.when(F.col("_better"), F.col("_step")).otherwise(F.transform("step", lambda s: s / 2))
    open_ = open_.withColumns({"_base": base, "_next": step})
    small = F.forall(F.zip_with("_base", "_next", lambda b, s: F.abs(s) <= tolerance * (1 + F.abs(b))), lambda ok: ok)
    stuck = F.col("_base").isNull() | F.col("_next").isNull()
    open_ = open_.withColumn("_small", F.coalesce(small, F.lit(False)))
    pick = lambda new, old: F.when(F.col("_better"), F.col(new)).otherwise(F.col(old))
    names = [c for c in open_.columns if c not in ("c", "base", "ll", "g", "step", "rounds", "done", "converged") and not c.startswith("_")]
    return open_.select(
        *names, plus(F.col("_base"), F.col("_next")).alias("c"), F.col("_base").alias("base"), pick("_ll", "ll").alias("ll"), pick("_grad", "g").alias("g"),
        F.col("_next").alias("step"), (F.col("rounds") + 1).alias("rounds"), (stuck | F.col("_small")).alias("done"), (~stuck & F.col("_small")).alias("converged"),
    )
