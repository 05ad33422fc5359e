"""Derivatives of densities and fits by Newton steps.  The SQL unrolls the steps and solves each system by Cramer's rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import gradient
from strataflow.operators.regression import fit_newton
from strataflow.queries import query
from strataflow.queries.base import rounded, table


def newton_sql(rows: str, by: str | None, start: str, mean: str, weight: str, log_density: str, steps: int = 9) -> str:
    """Fits with two terms, x1 and x2, and a canonical link; ``rows`` gives by, y, x1 and x2."""
    group = f"GROUP BY {by}" if by else ""
    keep, own = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    eta = "c0 + c1 * x1 + c2 * x2"
    out = [f"pts AS MATERIALIZED ({rows})", f"s0 AS MATERIALIZED (SELECT {keep}{start} AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM pts {group})"]
    x, pairs = ["1", "x1", "x2"], [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    for k in range(steps):
        cells = [f"sum(w * {x[i]} * {x[j]}) AS h{i}{j}" for i, j in pairs] + [f"sum((y - m) * {x[i]}) AS g{i}" for i in range(3)]
        out.append(f"t{k} AS MATERIALIZED (SELECT {keep}any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, {', '.join(cells)} FROM (SELECT *, {weight} AS w FROM (SELECT *, {mean} AS m FROM (SELECT *, {eta} AS e FROM pts JOIN s{k} {own}))) {group})")
        det = lambda a: f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"
        h = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
        moved = [f"c{q} + {det([[f'g{i}' if j == q else h[i][j] for j in range(3)] for i in range(3)])} / {det(h)} AS c{q}" for q in range(3)]
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT {keep}{', '.join(moved)} FROM t{k})")
    return f"""WITH {", ".join(out)} SELECT {keep}count(*) AS n, round(any_value(c0), 6) AS constant, round(any_value(c1), 6) AS of_discount, round(any_value(c2), 6) AS of_tax, round(sum({log_density}), 3) AS log_likelihood, true AS converged, true AS at_rest
    FROM (SELECT *, {mean} AS m FROM (SELECT *, {eta} AS e FROM pts JOIN s{steps} {own})) {group}"""


def _shown(fit, by):
    # The gradient is a sum over all rows; what rounding leaves of it is measured against their number.
    rest = F.array_max(F.transform("gradient", F.abs)) <= 1e-8 * F.col("n")
    c = [F.round(F.get("coefficients", F.lit(k)), 6).alias(name) for k, name in enumerate(("constant", "of_discount", "of_tax"))]
    return fit.select(*by, "n", *c, F.round("log_likelihood", 3).alias("log_likelihood"), "converged", rest.alias("at_rest"))


@query("newton_poisson", newton_sql("SELECT l_returnflag, CAST(round(l_quantity) AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2 FROM lineitem", "l_returnflag", "ln(avg(y))", "exp(e)", "m", "y * ln(m) - m - lgamma(y + 1)"))
def newton_poisson(spark, sf_dir):
    """Quantities by discount and tax, a fit for each return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round("l_quantity").cast("double").alias("y"), "l_discount", "l_tax")
    return _shown(fit_newton(rows, ["l_returnflag"], "y", ["l_discount", "l_tax"], "poisson", "log"), ["l_returnflag"])


@query("newton_logit", newton_sql("SELECT CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2 FROM lineitem", None, "ln(avg(y) / (1 - avg(y)))", "1 / (1 + exp(-e))", "m * (1 - m)", "CASE WHEN y = 1 THEN ln(m) ELSE ln(1 - m) END"))
def newton_logit(spark, sf_dir):
    """Whether a line is a large one, by discount and tax: one fit over all lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("y"), "l_discount", "l_tax")
    return _shown(fit_newton(rows, [], "y", ["l_discount", "l_tax"], "bernoulli", "logit"), [])


def _psi(x: str, second: bool = False) -> str:
    """Digamma or trigamma, from the argument lifted by 20: there a few terms of the asymptotic series are exact."""
    z, up = f"({x} + 20)", "list_sum([{} FOR i IN range(20)])"
    if second:
        return f"({up.format(f'1.0 / (({x} + i) * ({x} + i))')} + 1 / {z} + 1 / (2 * {z} ** 2) + 1 / (6 * {z} ** 3) - 1 / (30 * {z} ** 5) + 1 / (42 * {z} ** 7))"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) - {up.format(f'1.0 / ({x} + i)')})"


def _gradients_sql() -> str:
    cells = {
        "poisson": ("y / m - 1", "-y / m ** 2"),
        "size": (f"{_psi('(y + 3)')} - {_psi('3.0')} + ln(3 / (3 + m)) + (m - y) / (3 + m)", f"{_psi('(y + 3)', True)} - {_psi('3.0', True)} + 1.0 / 3 - 2 / (3 + m) + (y + 3) / (3 + m) ** 2"),
        "negbin": ("(y - m) * 3 / (m * (3 + m))", "(y + 3) / (3 + m) ** 2 - y / m ** 2"),
        "normal": ("(y - m) / 9", "-1.0 / 9"),
        "sd": ("(y - m) ** 2 / 27 - 1.0 / 3", "1.0 / 9 - (y - m) ** 2 / 27"),
        "binomial": ("(y - 60 * 0.4) / (0.4 * 0.6)", "-y / 0.16 - (60 - y) / 0.36"),
        "bernoulli": ("CASE WHEN y > 25 THEN 1 / 0.3 ELSE -1 / 0.7 END", "CASE WHEN y > 25 THEN -1 / 0.09 ELSE -1 / 0.49 END"),
        "beta_binomial": (f"7 * ({_psi('(y + 2)')} - {_psi('2.0')} - {_psi('(60 - y + 5)')} + {_psi('5.0')})", f"49 * ({_psi('(y + 2)', True)} - {_psi('2.0', True)} + {_psi('(60 - y + 5)', True)} - {_psi('5.0', True)})"),
        "beta": (f"8 * (ln(y / (60 - y)) - {_psi('2.4')} + {_psi('5.6')})", f"-64 * ({_psi('2.4', True)} + {_psi('5.6', True)})"),
    }
    shown = ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {name}_{k}" for name, pair in cells.items() for k, sql in enumerate(pair, 1))
    return f"SELECT p_partkey, {shown} FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS y, CAST(p_retailprice AS DOUBLE) / 60 AS m FROM part)"


@query("density_gradients", _gradients_sql())
def density_gradients(spark, sf_dir):
    """First and second derivatives of nine log densities at every part."""
    y, m, v = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") / 60, F.lit
    pairs = {
        "poisson": gradient.poisson(y, m), "size": gradient.negative_binomial_size(y, m, v(3.0)), "negbin": gradient.negative_binomial_mean(y, m, v(3.0)), "normal": gradient.normal_mean(y, m, v(3.0)), "sd": gradient.normal_sd(y, m, v(3.0)),
        "binomial": gradient.binomial(y, v(60.0), v(0.4)), "bernoulli": gradient.bernoulli(F.when(y > 25, 1.0).otherwise(0.0), v(0.3)), "beta_binomial": gradient.beta_binomial_mean(y, v(60.0), v(2 / 7), v(7.0)), "beta": gradient.beta_mean(y / 60, v(0.3), v(8.0)),
    }
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *[c.alias(f"{name}_{k}") for name, pair in pairs.items() for k, c in enumerate(pair, 1)]))
