"""First and second derivatives of the log densities by their mean, probability, spread or size, as columns.

Each function gives both as a pair.  They are null where the density is minus infinity or has no derivative (a mean or spread of 0,
a probability of 0 or 1), so that sums show the same rows as the density does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.density import TOLERANCE, negative_binomial
from strataflow.functions.special import digamma, normal_cdf, normal_mass, trigamma

Pair = tuple[Column, Column]


def _where(legal: Column, first: Column, second: Column) -> Pair:
    return F.when(legal, first), F.when(legal, second)


def _doubles(*xs: Column) -> tuple[Column, list[Column]]:
    """(none is NaN, all as doubles)"""
    xs = [x.cast("double") for x in xs]
    fine = F.lit(True)
    for x in xs:
        fine = fine & ~F.isnan(x)
    return fine, xs


def poisson(y: Column, mean: Column) -> Pair:
    fine, (y, m) = _doubles(y, mean)
    k = F.rint(y)
    return _where(fine & (k >= 0) & (m > 0), k / m - 1, -k / (m * m))


def negative_binomial_mean(y: Column, mean: Column, size: Column) -> Pair:
    fine, (y, m, s) = _doubles(y, mean, size)
    k = F.greatest(F.rint(y), F.lit(0.0))
    part = (k + s) / (s + m)
    return _where(fine & (m > 0) & (s > 0), k / m - part, part / (s + m) - k / (m * m))


def negative_binomial_size(y: Column, mean: Column, size: Column) -> Pair:
    fine, (y, m, s) = _doubles(y, mean, size)
    k, s1 = F.greatest(F.rint(y), F.lit(0.0)), F.when(s > 0, s).otherwise(1.0)
    part = (k + s1) / (s1 + m)
    first = digamma(k + s1) - digamma(s1) + F.log(s1 / (s1 + m)) + 1 - part
    second = trigamma(k + s1) - trigamma(s1) + 1 / s1 - 2 / (s1 + m) + part / (s1 + m)
    return _where(fine & (m > 0) & (s > 0), first, second)


def zero_inflated_negative_binomial_mean(y: Column, mean: Column, size: Column, zero: Column) -> Pair:
    """A zero is one of the distribution with the weight that it has in the mixture."""
    fine, (yy, p) = _doubles(y, zero)
    first, second = negative_binomial_mean(y, mean, size)
    own = (1 - p) * F.exp(negative_binomial(y, mean, size))
    w = own / (p + own)
    at_zero = F.rint(yy) == 0
    legal = fine & (p >= 0) & (p < 1)
    return _where(legal, F.when(at_zero, w * first).otherwise(first), F.when(at_zero, w * (second + first * first) - w * w * first * first).otherwise(second))


def normal_mean(y: Column, mean: Column, sd: Column) -> Pair:
    fine, (y, m, s) = _doubles(y, mean, sd)
    return _where(fine & (s > 0), (y - m) / (s * s), -1 / (s * s))


def normal_sd(y: Column, mean: Column, sd: Column) -> Pair:
    fine, (y, m, s) = _doubles(y, mean, sd)
    square = (y - m) * (y - m) / (s * s)
    return _where(fine & (s > 0), (square - 1) / s, (1 - 3 * square) / (s * s))


def discretised_normal_mean(y: Column, mean: Column, variance: Column, tolerance: float = TOLERANCE) -> Pair:
    fine, (y, m, v) = _doubles(y, mean, variance)
    s, k = F.sqrt(F.when(v > 0, v).otherwise(1.0)), F.rint(y)
    up, low = (k + 0.5 - m) / s, (k - 0.5 - m) / s
    bell = lambda z: F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    # A count of 0 takes the whole lower tail, whose other end adds nothing.
    mass = F.greatest(F.when(k > 0, normal_mass(low, up)).otherwise(normal_cdf(up)), F.lit(0.0)) + tolerance
    first = (F.when(k > 0, bell(low)).otherwise(0.0) - bell(up)) / s / mass
    second = (F.when(k > 0, low * bell(low)).otherwise(0.0) - up * bell(up)) / (s * s) / mass - first * first
    return _where(fine & (k >= 0) & (v > 0), first, second)


def binomial(k: Column, n: Column, p: Column) -> Pair:
    fine, (k, n, p) = _doubles(k, n, p)
    k, n = F.rint(k), F.rint(n)
    return _where(fine & (k >= 0) & (k <= n) & (p > 0) & (p < 1), k / p - (n - k) / (1 - p), -k / (p * p) - (n - k) / ((1 - p) * (1 - p)))


def bernoulli(y: Column, p: Column) -> Pair:
    first, second = binomial(y, F.lit(1.0), p)
    return _where(y.isin(0, 1), first, second)


def beta_binomial_mean(k: Column, n: Column, mean: Column, concentration: Column) -> Pair:
    """By the mean a / (a + b), where a + b is the concentration and stays."""
    fine, (k, n, m, c) = _doubles(k, n, mean, concentration)
    k, n = F.rint(k), F.rint(n)
    legal = fine & (k >= 0) & (k <= n) & (m > 0) & (m < 1) & (c > 0)
    a, b = (F.when(legal, x).otherwise(1.0) for x in (m * c, (1 - m) * c))
    first = c * (digamma(k + a) - digamma(a) - digamma(n - k + b) + digamma(b))
    return _where(legal, first, c * c * (trigamma(k + a) - trigamma(a) + trigamma(n - k + b) - trigamma(b)))


def beta_mean(x: Column, mean: Column, concentration: Column) -> Pair:
    fine, (x, m, c) = _doubles(x, mean, concentration)
    legal = fine & (x > 0) & (x < 1) & (m > 0) & (m < 1) & (c > 0)
    a, b = (F.when(legal, v).otherwise(1.0) for v in (m * c, (1 - m) * c))
    odds = F.when(legal, x / (1 - x)).otherwise(1.0)
    return _where(legal, c * (F.log(odds) - digamma(a) + digamma(b)), -c * c * (trigamma(a) + trigamma(b)))
