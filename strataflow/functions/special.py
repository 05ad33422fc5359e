"""Special functions as columns: log-gamma and its derivatives, the normal distribution and its quantile, incomplete gamma."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, n = 9.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
# Acklam's rational approximation of the normal quantile.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0."""
    z = F.greatest(x.cast("double"), F.lit(1e-300)) - 1
    # Below 1/2 the recurrence lifts the argument by one.
    small = z < -0.5
    y = F.when(small, z + 1).otherwise(z)
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + i)
    t = y + 7.5
    out = 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)
    return F.when(small, out - F.log(z + 1)).otherwise(out)


def digamma(x: Column) -> Column:
    """Derivative of log Gamma for x > 0: six steps of the recurrence, then the asymptotic series."""
    y = x.cast("double")
    out = F.lit(0.0)
    for i in range(6):
        out = out - 1 / (y + i)
    z = y + 6
    r = 1 / (z * z)
    return out + F.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: Column) -> Column:
    """Derivative of digamma for x > 0: eight steps of the recurrence, then the asymptotic series."""
    y = x.cast("double")
    out = F.lit(0.0)
    for i in range(8):
        out = out + 1 / ((y + i) * (y + i))
    z = y + 8
    r = 1 / (z * z)
    return out + 1 / z + 0.5 * r + r / z * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def _poly(c: list[float], x: Column) -> Column:
    out = F.lit(c[0])
    for a in c[1:]:
        out = out * x + a
    return out


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    mid = _poly(ACKLAM_A, r) * q / (_poly([*ACKLAM_B, 1.0], r))
    u = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(ACKLAM_C, u) / _poly([*ACKLAM_D, 1.0], u)
    out = F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(mid)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(out)


# Coefficients of the rational form of the normal tail (West 2005, after Hart), highest power first.
TAIL_ABOVE = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_BELOW = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
TAIL_SPLIT = 5.0


def normal_tail(x: Column) -> Column:
    """Mass of a standard normal above x >= 0: a rational form, and beyond ``TAIL_SPLIT`` a continued fraction."""
    e = F.exp(-x * x / 2)
    far = x + 0.65
    for k in range(24, 0, -1):
        far = x + k / far
    return F.when(x < TAIL_SPLIT, e * _poly(TAIL_ABOVE, x) / _poly(TAIL_BELOW, x)).otherwise(e / far / math.sqrt(2 * math.pi))


def normal_cdf(x: Column) -> Column:
    tail = normal_tail(F.abs(x))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_mass(lo: Column, hi: Column) -> Column:
    """Mass of a standard normal in [lo, hi]: above 0 as a difference of upper tails, which keeps its digits."""
    upper = normal_tail(F.abs(lo)) - normal_tail(F.abs(hi))
    return F.when(lo > 0, upper).when(hi < 0, -upper).otherwise(normal_cdf(hi) - normal_cdf(lo))


def _gamma_front(a: Column, x: Column) -> Column:
    """x^a exp(-x) / Gamma(a); from a = 10 on by Stirling's series around x = a, which keeps its digits."""
    d = (x - a) / a
    r = 1 / (a * a)
    tail = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / a
    large = F.sqrt(a / (2 * math.pi)) * F.exp(a * (F.log1p(d) - d) - tail)
    return F.when(a < 10, F.exp(a * F.log(x) - x - lgamma(a))).otherwise(large)


def _gamma_series(a: Column, x: Column) -> Column:
    """P / front: the series, which takes about 9 sqrt(a) terms where x is below a + 1."""
    n = F.ceil(40 + 9 * F.sqrt(a)).cast("int")
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), n), start, add, lambda s: s["total"])


def _gamma_fraction(a: Column, x: Column) -> Column:
    """Q / front: the continued fraction 1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ...)), from its innermost part outwards."""
    n = F.ceil(90 + 9 * F.sqrt(a)).cast("int")
    inner = lambda s, i: x + (2 * i + 1) - a - (i + 1) * (i + 1 - a) / s
    last = x + (2 * n + 1) - a
    return F.aggregate(F.sequence(n - 1, F.lit(0)), last, inner, lambda s: 1 / s)


def _gamma_sides(a: Column, x: Column) -> tuple[Column, Column]:
    """(P, Q) for a > 0 and x > 0, each computed where it is the smaller part or nearly so."""
    low = x < a + 1
    part = _gamma_front(a, x) * F.when(low, _gamma_series(a, x)).otherwise(_gamma_fraction(a, x))
    part = F.least(part, F.lit(1.0))
    return F.when(low, part).otherwise(1 - part), F.when(low, 1 - part).otherwise(part)


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma P(a, x) for a > 0: by its series below a + 1, by a continued fraction above."""
    a, x = a.cast("double"), x.cast("double")
    return F.when(x <= 0, F.lit(0.0)).when(x == float("inf"), F.lit(1.0)).otherwise(_gamma_sides(a, x)[0])


def gamma_q(a: Column, x: Column) -> Column:
    """The upper part 1 - P(a, x), without cancellation where it is small."""
    a, x = a.cast("double"), x.cast("double")
    return F.when(x <= 0, F.lit(1.0)).when(x == float("inf"), F.lit(0.0)).otherwise(_gamma_sides(a, x)[1])


def gamma_p_inverse(a: Column, p: Column, steps: int = 60) -> Column:
    """x with P(a, x) = p, for a > 0: Newton's method on log x, in a bracket that halves where a step would leave it.

    Below p = 1/2 it solves log P = log p, above it log Q = log(1 - p).  P(a, x) is below x^a / Gamma(a + 1), which gives the
    lower end.  As in every fold, a select must not give another column the name of ``a`` or ``p``.
    """
    a, p = a.cast("double"), p.cast("double")
    low = (F.log(p) + lgamma(a + 1)) / a
    z = normal_quantile(p)
    cube = 1 - 1 / (9 * a) + z / (3 * F.sqrt(a))
    high = F.log(2 * a + 40 * F.sqrt(a) + 800)
    guess = F.when((a >= 1) & (cube > 0.1), F.log(a * cube * cube * cube)).otherwise(low)
    start = F.struct(F.least(F.greatest(guess, low), high).alias("u"), low.alias("lo"), high.alias("hi"), F.lit(False).alias("done"))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(s: Column, i: Column) -> Column:
        def move(v: Column) -> Column:
            # v: gap of the logarithms and its slope in log x.
            below = F.when(p < 0.5, v["gap"] < 0).otherwise(v["gap"] > 0)
            lo, hi = F.when(below, s["u"]).otherwise(s["lo"]), F.when(below, s["hi"]).otherwise(s["u"])
            newton = s["u"] - v["gap"] / v["slope"]
            inside = (newton >= lo) & (newton <= hi) & (v["slope"] != 0)
            u = F.when(inside, newton).otherwise((lo + hi) / 2)
            return F.struct(u.alias("u"), lo.alias("lo"), hi.alias("hi"), (F.abs(u - s["u"]) <= 4e-16 * (1 + F.abs(u))).alias("done"))

        x = F.exp(s["u"])
        sides = _gamma_sides(a, x)
        front = _gamma_front(a, x)
        value = F.when(p < 0.5, F.struct((F.log(sides[0]) - F.log(p)).alias("gap"), (front / sides[0]).alias("slope")))
        value = value.otherwise(F.struct((F.log(sides[1]) - F.log1p(-p)).alias("gap"), (-front / sides[1]).alias("slope")))
        return F.when(s["done"], s).otherwise(let(value, move))

    out = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["u"]))
    return F.when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(float("inf"))).otherwise(out)
