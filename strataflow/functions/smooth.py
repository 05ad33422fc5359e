"""Penalised splines: B-splines on clamped knots, whose roughness is the integral of the squared second derivative.

What depends on knots alone (a few dozen numbers) is made on the driver: Greville points, the roughness matrix, and its split
into lines, which have no roughness, and modes, which have roughness 1 each and are orthogonal in it.  Values at rows are columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.checks import Refused
from strataflow.functions.forcing import b_spline


class SmoothBasis:
    """B-splines of a degree from 2 to 5 on increasing knots; times outside are held at the ends."""

    def __init__(self, knots: Sequence[float], degree: int = 3):
        self.knots, self.degree = [float(k) for k in knots], degree
        if not 2 <= degree <= 5:
            raise Refused("a roughness penalty needs a degree from 2 to 5")
        if len(self.knots) < 2 or any(b <= a for a, b in zip(self.knots, self.knots[1:], strict=False)):
            raise Refused("knots must increase strictly")
        self.full = [self.knots[0]] * degree + self.knots + [self.knots[-1]] * degree
        self.n_spans = len(self.knots) - 1
        self.n = self.n_spans + degree
        if self.n < 3:
            raise Refused("fewer than 3 basis functions leave only lines")

    @property
    def middle(self) -> float:
        return (self.knots[0] + self.knots[-1]) / 2

    @cached_property
    def greville(self):
        """Coefficients of the line g(t) = t: the mean of each function's inner knots."""
        import numpy as np

        return np.array([np.mean(self.full[k + 1 : k + 1 + self.degree]) for k in range(self.n)])

    @cached_property
    def roughness(self):
        """The matrix of integrals of products of second derivatives: second differences of coefficients, met by the Gram
        matrix of the B-splines two degrees lower, by a rule that is exact for their products."""
        import numpy as np

        change, u = np.eye(self.n), self.full
        for p in (self.degree, self.degree - 1):
            # The derivative's coefficients on the knots without the outermost two.
            u_in = u[1:-1]
            change = np.array([p * (change[i + 1] - change[i]) / (u[i + p + 1] - u[i + 1]) for i in range(len(change) - 1)])
            u = u_in
        low = self.degree - 2
        nodes, weights = np.polynomial.legendre.leggauss(low + 1)
        gram = np.zeros((len(change), len(change)))
        for s, (a, b) in enumerate(zip(self.knots, self.knots[1:], strict=False)):
            for x, w in zip(nodes, weights, strict=True):
                v = _local(u, low, s, a + (b - a) * (x + 1) / 2)
                gram[s : s + low + 1, s : s + low + 1] += (b - a) / 2 * w * np.outer(v, v)
        return change.T @ gram @ change

    @cached_property
    def _split(self):
        """(lines, modes, inverse): coefficients = lines (level, slope) + modes z, and z = inverse coefficients."""
        import numpy as np

        lines = np.stack([np.ones(self.n), self.greville - self.middle], axis=1)
        rest = np.linalg.qr(lines, mode="complete")[0][:, 2:]
        lower = np.linalg.cholesky(rest.T @ self.roughness @ rest)
        return lines, np.linalg.solve(lower, rest.T).T, (rest @ lower).T

    @property
    def lines(self):
        return self._split[0]

    @property
    def modes(self):
        return self._split[1]

    @property
    def to_modes(self):
        return self._split[2]

    def scale(self, reference: float) -> float:
        """Divides a deviation so that it has no unit and does not depend on the number of knots."""
        return (self.n - 2) ** 0.5 * reference**1.5

    def coefficients(self, level: float, slope: float, deviation: float, z: Sequence[float], reference: float = 1.0) -> list[float]:
        """Of the curve with this level and slope at mid-window, and modes z times deviation / scale."""
        import numpy as np

        if len(z) != self.n - 2:
            raise Refused(f"{self.n - 2} modes are needed")
        return (self.lines @ [level, slope] + deviation / self.scale(reference) * (self.modes @ np.asarray(z, float))).tolist()

    def at(self, t: Column) -> tuple[Column, list[Column]]:
        """(span, values of the degree + 1 functions that are alive there, beginning with function number ``span``)."""
        p = self.degree
        inner = F.least(F.greatest(t, F.lit(self.knots[0])), F.lit(self.knots[-1]))
        span = sum(((inner >= k).cast("int") for k in self.knots[1:-1]), F.lit(0))
        knots = F.array(*[F.lit(k) for k in self.full])
        knot = lambda j: F.get(knots, span + j)
        values = [F.lit(1.0)]
        for k in range(1, p + 1):
            grown = [F.lit(0.0)] * (k + 1)
            for r, v in enumerate(values):
                left, right = knot(p + r + 1 - k), knot(p + r + 1)
                part = v / (right - left)
                grown[r] = grown[r] + (right - inner) * part
                grown[r + 1] = grown[r + 1] + (inner - left) * part
            values = grown
        return span, values


def _local(full: Sequence[float], degree: int, span: int, t: float) -> list[float]:
    """Values of the functions alive on a span, in plain numbers."""
    values = [1.0]
    for k in range(1, degree + 1):
        grown = [0.0] * (k + 1)
        for r, v in enumerate(values):
            left, right = full[span + degree + r + 1 - k], full[span + degree + r + 1]
            grown[r] += (right - t) * v / (right - left)
            grown[r + 1] += (t - left) * v / (right - left)
        values = grown
    return values


def smooth(t: Column, basis: SmoothBasis, level: float, slope: float, deviation: float, z: Sequence[float], reference: float = 1.0) -> Column:
    """A forcing from a level, a slope and roughness modes; with z = 0 it is the line level + slope (t - mid-window)."""
    return b_spline(t, basis.knots, basis.degree, basis.coefficients(level, slope, deviation, z, reference))
