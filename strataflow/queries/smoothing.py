"""Penalised splines over all events.  The SQL makes basis functions by their recursion and solves the whole system by elimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions.smooth import SmoothBasis, smooth
from strataflow.operators.smoothing import fit_smooth, smooth_values
from strataflow.queries import query
from strataflow.queries.base import rounded, table

BASIS = SmoothBasis([0, 4, 9, 15, 20, 26, 30])
PENALTY = 500.0
YEARS = SmoothBasis([0, 400, 1000, 1500, 2400, 3600])
MODES = [1.0, -0.5, 0.25, 0.0, 2.0, -1.0]

POINTS = "pts AS (SELECT event_type AS g, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + CAST(floor(extract(second FROM ts)) AS BIGINT)) / 86400.0 AS t, value AS y FROM events)"


def _points(spark, sf_dir):
    ts = F.col("ts")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return table(spark, sf_dir, "events").select("event_type", (F.datediff(ts, F.lit("2024-01-01").cast("date")) + seconds / 86400.0).alias("t"), "value")


def basis_sql(basis: SmoothBasis, source: str, keep: str) -> str:
    """CTEs n0 .. n<degree> with columns b0, b1, ...: each degree from the one below, all functions at every row."""
    u, p = basis.full, basis.degree
    last = max(i for i in range(len(u) - 1) if u[i] < u[i + 1])
    flat = [f"CAST({'x >= ' + str(u[i]) + ' AND x ' + ('<=' if i == last else '<') + ' ' + str(u[i + 1]) if u[i] < u[i + 1] else 'false'} AS INTEGER) AS b{i}" for i in range(len(u) - 1)]
    steps = [f"n0 AS (SELECT {keep}, x, {', '.join(flat)} FROM (SELECT *, least(greatest(t, {u[0]}), {u[-1]}) AS x FROM {source}))"]
    for k in range(1, p + 1):
        cells = []
        for i in range(len(u) - 1 - k):
            rise = f"(x - {u[i]}) / {u[i + k] - u[i]} * b{i}" if u[i + k] > u[i] else "0.0"
            fall = f"({u[i + k + 1]} - x) / {u[i + k + 1] - u[i + 1]} * b{i + 1}" if u[i + k + 1] > u[i + 1] else "0.0"
            cells.append(f"{rise} + {fall} AS b{i}")
        steps.append(f"n{k} AS {'MATERIALIZED ' if k == p else ''}(SELECT {keep}, x, {', '.join(cells)} FROM n{k - 1})")
    return ", ".join(steps)


def solve_sql(basis: SmoothBasis, penalty: float) -> str:
    """CTE ``fit`` with g, n and the coefficients c0, c1, ... from the rows of the basis, by elimination without a band."""
    k = basis.n
    cells = [f"sum(b{i} * b{j}) + {float(penalty * basis.roughness[i, j])!r} AS a{i}_{j}" for i in range(k) for j in range(k)]
    steps = [f"e0 AS MATERIALIZED (SELECT g, count(*) AS n, {', '.join(cells)}, {', '.join(f'sum(b{i} * y) AS r{i}' for i in range(k))} FROM n{basis.degree} GROUP BY g)"]
    for s in range(k):
        cells = [f"a{i}_{j} - a{i}_{s} / a{s}_{s} * a{s}_{j} AS a{i}_{j}" if i != s else f"a{i}_{j}" for i in range(k) for j in range(s, k)]
        right = [f"r{i} - a{i}_{s} / a{s}_{s} * r{s} AS r{i}" if i != s else f"r{i}" for i in range(k)]
        done = [f"a{i}_{i}" for i in range(s)]
        steps.append(f"e{s + 1} AS MATERIALIZED (SELECT g, n, {', '.join([*done, *cells, *right])} FROM e{s})")
    steps.append(f"fit AS MATERIALIZED (SELECT g, n, {', '.join(f'r{i} / a{i}_{i} AS c{i}' for i in range(k))} FROM e{k})")
    return ", ".join(steps)


def _sum(weights, letter: str = "c") -> str:
    return " + ".join(f"{float(w)!r} * {letter}{i}" for i, w in enumerate(weights))


def _fit_sql() -> str:
    import numpy as np

    line, k = np.linalg.pinv(BASIS.lines), BASIS.n
    curve = " + ".join(f"c{i} * b{i}" for i in range(k))
    rough = " + ".join(f"{float(BASIS.roughness[i, j])!r} * c{i} * c{j}" for i in range(k) for j in range(k))
    return f"""WITH {POINTS}, {basis_sql(BASIS, "pts", "g, y")}, {solve_sql(BASIS, PENALTY)},
    left_over AS (SELECT g, sum((y - ({curve})) * (y - ({curve}))) AS rss FROM n{BASIS.degree} JOIN fit USING (g) GROUP BY g)
    SELECT g AS event_type, k, round(greville, 6) AS greville, round(c, 4) AS coefficient, round({_sum(line[0])}, 4) AS level, round({_sum(line[1])}, 5) AS slope, round({rough}, 5) AS roughness, round(rss / n, 3) AS mean_square, n
    FROM (SELECT *, unnest(range({k})) AS k, unnest([{", ".join(f"c{i}" for i in range(k))}]) AS c, unnest({BASIS.greville.tolist()}) AS greville FROM fit JOIN left_over USING (g))"""


@query("smooth_fit", _fit_sql())
def smooth_fit(spark, sf_dir):
    """Coefficients of the penalised curve of every event type, its line, roughness and what is left over."""
    fit = fit_smooth(_points(spark, sf_dir), ["event_type"], "t", "value", BASIS, PENALTY)
    at = F.array(*[F.lit(float(x)) for x in BASIS.greville])
    rows = fit.select("event_type", "level", "slope", "roughness", (F.col("rss") / F.col("n")).alias("mean_square"), "n", F.posexplode("coefficients").alias("k", "coefficient"))
    out = rows.select("event_type", F.col("k").cast("long").alias("k"), F.round(F.get(at, F.col("k")), 6).alias("greville"), F.round("coefficient", 4).alias("coefficient"), F.round("level", 4).alias("level"), F.round("slope", 5).alias("slope"), F.round("roughness", 5).alias("roughness"), F.round("mean_square", 3).alias("mean_square"), "n")
    return out


def _values_sql() -> str:
    curve = " + ".join(f"c{i} * b{i}" for i in range(BASIS.n))
    return f"""WITH {POINTS}, {basis_sql(BASIS, "pts", "g, y")}, {solve_sql(BASIS, PENALTY)}
    SELECT g AS event_type, CAST(floor(x) AS BIGINT) AS day, count(*) AS n, round(avg({curve}), 4) AS fitted, round(avg(y - ({curve})), 4) AS residual FROM n{BASIS.degree} JOIN fit USING (g) GROUP BY ALL"""


@query("smooth_residuals", _values_sql())
def smooth_residuals(spark, sf_dir):
    """The fitted curve at every event, and what it leaves, by day."""
    points = _points(spark, sf_dir)
    values = smooth_values(points, fit_smooth(points, ["event_type"], "t", "value", BASIS, PENALTY), ["event_type"], "t", BASIS)
    out = values.groupBy("event_type", F.floor("t").alias("day")).agg(F.count("*").alias("n"), F.avg("fitted").alias("fitted"), F.avg(F.col("value") - F.col("fitted")).alias("residual"))
    return rounded(out, 4)


def _forcing_sql() -> str:
    # Held against the definition: the line is exact, and the modes' part has the roughness (deviation / scale)^2 |z|^2.
    return f"""WITH pts AS (SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS t, count(*) AS n FROM orders GROUP BY 1), {basis_sql(YEARS, "pts", "t, n")}
    SELECT t, n, round(2.0 + 0.001 * (x - {YEARS.middle}), 6) AS line, round({_sum(YEARS.coefficients(2.0, 0.001, 0.3, MODES, 30.0), "b")}, 6) AS curve FROM n{YEARS.degree}"""


@query("smooth_forcing", _forcing_sql())
def smooth_forcing(spark, sf_dir):
    """A forcing of a level, a slope and modes on all order days."""
    days = table(spark, sf_dir, "orders").groupBy(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("t")).agg(F.count("*").alias("n"))
    t, none = F.col("t"), [0.0] * len(MODES)
    return rounded(days.select("t", "n", smooth(t, YEARS, 2.0, 0.001, 0.0, none).alias("line"), smooth(t, YEARS, 2.0, 0.001, 0.3, MODES, 30.0).alias("curve")))
