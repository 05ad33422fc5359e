"""Log densities of observation families, priors and parameter transforms, as columns.

A NaN argument or one outside its domain scores minus infinity and is never clamped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.arithmetic import finite
from strataflow.functions.special import lgamma, normal_cdf, normal_mass

NEVER = float("-inf")
TOLERANCE = 1e-18


def _args(*xs: Column) -> tuple[Column, list[Column]]:
    xs = [x.cast("double") for x in xs]
    bad = F.lit(False)
    for x in xs:
        bad = bad | F.isnan(x)
    return bad, xs


def _log(x: Column) -> Column:
    return F.log(F.when(x > 0, x).otherwise(F.lit(1.0)))


def poisson(y: Column, mean: Column) -> Column:
    bad, (y, m) = _args(y, mean)
    k = F.rint(y)
    return F.when(bad | (k < 0), NEVER).when(m <= 0, F.when(k == 0, 0.0).otherwise(NEVER)).otherwise(k * _log(m) - m - lgamma(k + 1))


def negative_binomial(y: Column, mean: Column, size: Column) -> Column:
    bad, (y, m, s) = _args(y, mean, size)
    k = F.greatest(F.rint(y), F.lit(0.0))
    s1 = F.when(s > 0, s).otherwise(1.0)
    m1 = F.when(m > 0, m).otherwise(1.0)
    out = lgamma(k + s1) - lgamma(k + 1) - lgamma(s1) + s1 * F.log(s1 / (s1 + m1)) + k * F.log(m1 / (s1 + m1))
    return F.when(bad, NEVER).when(m <= 0, F.when(F.rint(y) == 0, 0.0).otherwise(NEVER)).when(s <= 0, NEVER).otherwise(out)


def is_probability(p: Column) -> Column:
    return (p >= 0) & (p <= 1) & ~F.isnan(p)


def log_add(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == NEVER, NEVER).otherwise(top + F.log(F.exp(a - top) + F.exp(b - top)))


def zero_inflated_negative_binomial(y: Column, mean: Column, size: Column, zero: Column) -> Column:
    bad, (yy, _, _, p) = _args(y, mean, size, zero)
    base = negative_binomial(y, mean, size)
    rest = F.when(p < 1, _log(1 - p) + base).otherwise(NEVER)
    return F.when(bad | ~is_probability(p), NEVER).when(F.rint(yy) == 0, log_add(F.when(p > 0, _log(p)).otherwise(NEVER), rest)).otherwise(rest)


def normal(y: Column, mean: Column, sd: Column) -> Column:
    bad, (y, m, s) = _args(y, mean, sd)
    z = (y - m) / F.when(s > 0, s).otherwise(1.0)
    return F.when(bad | (s <= 0), NEVER).otherwise(-0.5 * z * z - _log(s) - 0.5 * math.log(2 * math.pi))


def discretised_normal(y: Column, mean: Column, variance: Column, tolerance: float = TOLERANCE) -> Column:
    """Normal mass of [y - 1/2, y + 1/2), with a floor; a count of 0 takes the whole lower tail."""
    bad, (y, m, v) = _args(y, mean, variance)
    s = F.sqrt(F.when(v > 0, v).otherwise(1.0))
    k = F.rint(y)
    up = (k + 0.5 - m) / s
    mass = F.when(k > 0, normal_mass((k - 0.5 - m) / s, up)).otherwise(normal_cdf(up))
    return F.when(bad | (k < 0), NEVER).otherwise(F.log(F.greatest(mass, F.lit(0.0)) + tolerance))


def _choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def binomial(k: Column, n: Column, p: Column) -> Column:
    bad, (k, n, p) = _args(k, n, p)
    k, n = F.rint(k), F.rint(n)
    # 0 * log 0 counts as 0.
    a = F.when(k == 0, 0.0).when(p > 0, k * _log(p)).otherwise(NEVER)
    b = F.when(n == k, 0.0).when(p < 1, (n - k) * _log(1 - p)).otherwise(NEVER)
    legal = (k >= 0) & (k <= n) & is_probability(p)
    inner = F.when(legal, k).otherwise(0.0), F.when(legal, n).otherwise(0.0)
    return F.when(bad | ~legal, NEVER).when((n == 0) & (k == 0), 0.0).otherwise(_choose(inner[1], inner[0]) + a + b)


def bernoulli(y: Column, p: Column) -> Column:
    bad, (y, p) = _args(y, p)
    hit = F.when(y == 1, p).when(y == 0, 1 - p)
    return F.when(bad | ~is_probability(p) | hit.isNull() | (hit <= 0), NEVER).otherwise(_log(hit))


def beta_binomial(k: Column, n: Column, alpha: Column, beta: Column) -> Column:
    bad, (k, n, a, b) = _args(k, n, alpha, beta)
    k, n = F.rint(k), F.rint(n)
    legal = (k >= 0) & (k <= n) & (a > 0) & (b > 0)
    k1, n1, a1, b1 = (F.when(legal, x).otherwise(1.0) for x in (k, n, a, b))
    log_beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return F.when(bad | ~legal, NEVER).when(n == 0, 0.0).otherwise(_choose(n1, k1) + log_beta(k1 + a1, n1 - k1 + b1) - log_beta(a1, b1))


def beta(x: Column, mean: Column, concentration: Column) -> Column:
    bad, (x, m, c) = _args(x, mean, concentration)
    legal = (x > 0) & (x < 1) & (m > 0) & (m < 1) & (c > 0)
    m1, c1, x1 = F.when(legal, m).otherwise(0.5), F.when(legal, c).otherwise(1.0), F.when(legal, x).otherwise(0.5)
    a, b = m1 * c1, (1 - m1) * c1
    return F.when(bad | ~legal, NEVER).otherwise((a - 1) * F.log(x1) + (b - 1) * F.log(1 - x1) + lgamma(c1) - lgamma(a) - lgamma(b))


def diagnostic_test(p: Column, sensitivity: Column, specificity: Column) -> Column:
    """Probability of a positive imperfect test."""
    return sensitivity * p + (1 - specificity) * (1 - p)


def support_violation(y: Column, family: str, n: Column | None = None) -> Column:
    """Why a value can't come from a family, or null."""
    whole = (y >= 0) & (y == F.floor(y))
    out = F.when(y.isNotNull() & ~finite(y.cast("double")), "not finite")
    if family in ("poisson", "negative_binomial", "binomial", "beta_binomial"):
        out = out.when(~whole, "not a count")
    if family == "bernoulli":
        out = out.when(~y.isin(0, 1), "neither 0 nor 1")
    if n is not None:
        out = out.when(y > n, "more successes than trials")
    return out


def prior(x: Column, family: str, *a: float) -> Column:
    """Log prior density; fixed and flat priors score 0."""
    x = x.cast("double")
    pos = F.when(x > 0, x).otherwise(1.0)
    inside = lambda lo, hi, v: F.when((x >= lo) & (x <= hi), v).otherwise(NEVER)
    if family in ("flat", "fixed"):
        return F.lit(0.0)
    if family == "uniform":
        return inside(a[0], a[1], F.lit(-math.log(a[1] - a[0])))
    if family == "log_uniform":
        return inside(a[0], a[1], -F.log(pos) - math.log(math.log(a[1] / a[0])))
    if family == "normal":
        return normal(x, F.lit(a[0]), F.lit(a[1]))
    if family == "half_normal":
        return F.when(x >= 0, normal(x, F.lit(0.0), F.lit(a[0])) + math.log(2)).otherwise(NEVER)
    if family == "log_normal":
        return F.when(x > 0, normal(F.log(pos), F.lit(a[0]), F.lit(a[1])) - F.log(pos)).otherwise(NEVER)
    if family == "truncated_normal":
        cdf = lambda v: 0.5 * math.erfc(-(v - a[0]) / a[1] / math.sqrt(2))
        return inside(a[2], a[3], normal(x, F.lit(a[0]), F.lit(a[1])) - math.log(cdf(a[3]) - cdf(a[2])))
    if family == "exponential":
        return F.when(x >= 0, math.log(a[0]) - a[0] * x).otherwise(NEVER)
    if family == "gamma":
        return F.when(x > 0, a[0] * math.log(a[1]) - math.lgamma(a[0]) + (a[0] - 1) * F.log(pos) - a[1] * x).otherwise(NEVER)
    if family == "beta":
        unit = F.when((x > 0) & (x < 1), x).otherwise(0.5)
        c = math.lgamma(a[0] + a[1]) - math.lgamma(a[0]) - math.lgamma(a[1])
        return F.when((x > 0) & (x < 1), c + (a[0] - 1) * F.log(unit) + (a[1] - 1) * F.log(1 - unit)).otherwise(NEVER)
    raise ValueError(f"unknown prior {family}")


def prior_given(x: Column, family: str, *a: Column) -> Column:
    """Log prior density whose arguments are columns, such as the values of a level above; minus infinity where they are illegal."""
    bad, (x, *a) = _args(x, *a)
    pos = F.when(x > 0, x).otherwise(1.0)
    legal = F.lit(True)
    if family == "normal":
        out = normal(x, a[0], a[1])
    elif family == "half_normal":
        legal, out = x >= 0, normal(x, F.lit(0.0), a[0]) + math.log(2)
    elif family == "log_normal":
        legal, out = x > 0, normal(F.log(pos), a[0], a[1]) - F.log(pos)
    elif family == "exponential":
        legal, out = (x >= 0) & (a[0] > 0), _log(a[0]) - a[0] * x
    elif family == "gamma":
        legal, out = (x > 0) & (a[0] > 0) & (a[1] > 0), a[0] * _log(a[1]) - lgamma(a[0]) + (a[0] - 1) * F.log(pos) - a[1] * x
    else:
        raise ValueError(f"no prior {family} with columns as arguments")
    return F.when(~bad & legal, out).otherwise(NEVER)


def transform(x: Column, support: str, lo: float | None = None, hi: float | None = None) -> Column:
    """To the whole line: identity, lower, upper, interval or log_interval."""
    if support == "identity":
        return x
    if support == "lower":
        return F.log(x - lo)
    if support == "upper":
        return -F.log(hi - x)
    if support == "log_interval":
        x, lo, hi = F.log(x), math.log(lo), math.log(hi)
    elif support != "interval":
        raise ValueError(f"unknown support {support}")
    return F.log((x - lo) / (hi - x))


def inverse_transform(z: Column, support: str, lo: float | None = None, hi: float | None = None) -> tuple[Column, Column]:
    """(x, log of the absolute derivative of x by z)."""
    if support == "identity":
        return z, F.lit(0.0)
    if support == "lower":
        return lo + F.exp(z), z
    if support == "upper":
        return hi - F.exp(-z), -z
    u = 1 / (1 + F.exp(-z))
    if support == "interval":
        return lo + (hi - lo) * u, math.log(hi - lo) + F.log(u) + F.log(1 - u)
    if support == "log_interval":
        span = math.log(hi / lo)
        x = lo * F.exp(span * u)
        return x, F.log(x) + math.log(span) + F.log(u) + F.log(1 - u)
    raise ValueError(f"unknown support {support}")


def to_log_barycentric(shares: list[Column], floor: float = 1e-300) -> list[Column]:
    """Logs of shares scaled to sum to 1; shares below the floor count as the floor."""
    held = [F.greatest(x, F.lit(floor)) for x in shares]
    total = sum(held[1:], held[0])
    return [F.log(F.greatest(x / total, F.lit(floor))) for x in held]


def from_log_barycentric(z: list[Column]) -> list[Column]:
    """Shares from log ratios by a softmax that can't overflow; they sum to 1."""
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = sum(e[1:], e[0])
    return [x / total for x in e]
