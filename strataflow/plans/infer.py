"""Likelihood-based fitting: one group per parameter point or chain, particles as NumPy arrays inside the group.

Observations are one small series (a plan argument, at most a few thousand rows); the grid of points, replicates and chains
is the distributed side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import Refused
from strataflow.functions import density
from strataflow.plans.model import Model
from strataflow.plans.simulate import Kernel, compile_rate, ode, whole

Series = Sequence[tuple[float, float | None]]


def log_poisson(y: float, mean):
    import numpy as np

    m = np.maximum(mean, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = y * np.log(m) - m - math.lgamma(y + 1)
    return np.where(m > 0, out, 0.0 if y == 0 else -np.inf)


def log_negative_binomial(y: float, mean, size: float):
    import numpy as np

    m = np.maximum(mean, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = math.lgamma(y + size) - math.lgamma(y + 1) - math.lgamma(size) + size * np.log(size / (size + m)) + (y * np.log(m / (size + m)) if y else 0.0)
    return np.where(m > 0, out, 0.0 if y == 0 else -np.inf)


def systematic(weights, u: float):
    """Indices of a systematic resample of normalised weights."""
    import numpy as np

    n = len(weights)
    return np.minimum(np.searchsorted(np.cumsum(weights), (u + np.arange(n)) / n, side="right"), n - 1)


def conditional_multinomial(weights, reference: int, rng):
    """Independent indices; the first place keeps the reference."""
    import numpy as np

    out = np.minimum(np.searchsorted(np.cumsum(weights), rng.random(len(weights)), side="right"), len(weights) - 1)
    out[0] = reference
    return out


def trace_paths(ancestors, last: Sequence[int]):
    """Indices (steps, paths) of the particles on the way to the given last ones."""
    import numpy as np

    now, out = np.asarray(last), [np.asarray(last)]
    for a in reversed(ancestors[1:]):
        now = a[now]
        out.append(now)
    return np.stack(out[::-1])


@dataclass(frozen=True)
class Stream:
    """Observations of one flow at their own times; ``reporting`` and ``size`` name parameters (no size: Poisson)."""

    flow: str
    series: tuple[tuple[float, float | None], ...]
    reporting: str
    size: str | None = None


class StreamsFilter:
    """Bootstrap filter over several streams.

    Particles stop at the union of the streams' times.  Every stream sums its flow since its own last time, also over the times
    of others; at a stop the log densities of the streams that have an observation there are added.  A hole closes its stream's
    window and scores nothing; a stop with holes only weighs nothing.
    """

    def __init__(self, model: Model, streams: dict[str, Stream], start: float, dt: float):
        self.model, self.start, self.dt = model, start, dt
        self.kernel = Kernel(model)
        names = [t.name for t in self.kernel.model.transitions]
        self.streams = {k: (names.index(s.flow), dict(s.series), s) for k, s in streams.items()}
        self.axis = sorted({t for s in streams.values() for t, _ in s.series})
        self.initial = {c: compile_rate(e) for c, e in model.initial.items()}

    def run(self, parameters: dict, particles: int, rng) -> list[tuple]:
        """(time, stream, y, log score of the stream, joint log score, ESS) of every observation; a dead filter ends with -inf."""
        import numpy as np

        state = {c: np.full(particles, whole(np.float64(self.initial[c](parameters))) if c in self.initial else 0, np.int64) for c in self.model.compartments}
        sums = {k: np.zeros(particles) for k in self.streams}
        t, out = self.start, []
        mean_of = lambda w: float(w.max() + math.log(np.exp(w - w.max()).mean())) if np.isfinite(w.max()) else -math.inf
        for stop in self.axis:
            while t < stop - 1e-9:
                h = min(self.dt, stop - t)
                flows = self.kernel.step(state, parameters, t, h, rng)
                for k, (i, _, _) in self.streams.items():
                    sums[k] += flows[i]
                t += h
            due = {k: series[stop] for k, (_, series, _) in self.streams.items() if stop in series}
            each = {}
            for k, y in due.items():
                if y is not None:
                    s = self.streams[k][2]
                    mean = parameters[s.reporting] * sums[k]
                    each[k] = log_poisson(y, mean) if s.size is None else log_negative_binomial(y, mean, float(parameters[s.size]))
                sums[k] = np.zeros(particles)
            if not each:
                continue
            logw = sum(each.values())
            joint = mean_of(logw)
            if not math.isfinite(joint):
                return [*out, *[(stop, k, due[k], mean_of(w), -math.inf, 0.0) for k, w in each.items()]]
            w = np.exp(logw - logw.max())
            w /= w.sum()
            out += [(stop, k, due[k], mean_of(v), joint, 1 / float((w * w).sum())) for k, v in each.items()]
            if np.ptp(logw):
                pick = systematic(w, rng.random())
                state = {c: v[pick] for c, v in state.items()}
                sums = {k: v[pick] for k, v in sums.items()}
        return out


def stream_scores(points: DataFrame, filt: StreamsFilter, particles: int, key: str = "point_id") -> DataFrame:
    """One row per point, time and stream: its log score, the joint score of that time and the ESS.  Streams are never summed."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(getattr(r, key), *x) for r in pdf.itertuples(index=False) for x in filt.run(_parameters(r, filt.model), particles, _seeded(r.seed, 7))]
            yield pd.DataFrame(rows, columns=[key, "t", "stream", "y_obs", "log_score", "joint", "ess"])

    return points.mapInPandas(run, f"`{key}` long, t double, stream string, y_obs double, log_score double, joint double, ess double")


def ode_prequential(cells: DataFrame, model: Model, observations: DataFrame, flow: str, start: float, stop: float, dt: float, reporting: str, size: str | None = None) -> DataFrame:
    """(cell columns, t, y_obs, predicted, log_score) of observations (t, y) under the deterministic path, by columns alone.

    A window's flow is what the path has sent since the observation before; observation times must be ends of steps.
    """
    path = ode(cells, model, start, stop, dt)
    at = F.round((F.col("time") - start) / dt).cast("long")
    order = W.partitionBy(*cells.columns).orderBy("_at")
    path = path.withColumn("_at", at).withColumn("_sent", F.sum(f"flow_{flow}").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    seen = observations.select(F.col("t"), F.col("y").cast("double").alias("y_obs"), F.round((F.col("t") - start) / dt).cast("long").alias("_at"))
    rows = path.join(seen, "_at").withColumn("_before", F.coalesce(F.lag("_sent").over(order), F.lit(0.0)))
    mean = F.col(reporting) * (F.col("_sent") - F.col("_before"))
    score = density.poisson(F.col("y_obs"), mean) if size is None else density.negative_binomial(F.col("y_obs"), mean, F.col(size))
    return rows.select(*cells.columns, "t", "y_obs", mean.alias("predicted"), score.alias("log_score")).where("y_obs is not null")


class Filter:
    """Bootstrap filter: propagate, sum the observed flow, weigh, resample.  Dead particles get weight 0."""

    def __init__(self, model: Model, series: Series, flow: str, start: float, dt: float, reporting: str, size: str | None = None):
        self.model, self.series, self.start, self.dt = model, list(series), start, dt
        self.kernel = Kernel(model)
        self.flow = [t.name for t in self.kernel.model.transitions].index(flow)
        self.reporting, self.size = reporting, size
        self.initial = {c: compile_rate(e) for c, e in model.initial.items()}

    def begin(self, parameters: dict, n: int) -> dict:
        import numpy as np

        env = dict(parameters)
        return {c: np.full(n, whole(np.float64(self.initial[c](env))) if c in self.initial else 0, np.int64) for c in self.model.compartments}

    def density(self, y: float, flow, parameters: dict):
        mean = parameters[self.reporting] * flow
        return log_poisson(y, mean) if self.size is None else log_negative_binomial(y, mean, float(parameters[self.size]))

    def run(self, parameters: dict, particles: int, rng, record: bool = False, perturb: Callable | None = None) -> dict:
        import numpy as np

        env = {k: np.full(particles, v, float) if perturb else v for k, v in parameters.items()}
        state, t, total = self.begin(parameters, particles), self.start, 0.0
        steps, ancestors, kept = [], [], []
        for k, (stop, y) in enumerate(self.series):
            if perturb:
                env = perturb(env, k)
            flow = np.zeros(particles)
            while t < stop - 1e-9:
                h = min(self.dt, stop - t)
                flow += self.kernel.step(state, env, t, h, rng)[self.flow]
                t += h
            if y is None:  # a hole: the window closes and nothing is scored
                steps.append((stop, None, float("nan"), float(particles), flow))
                ancestors.append(np.arange(particles))
                continue
            logw = self.density(y, flow, env)
            top = logw.max()
            if not np.isfinite(top):
                steps.append((stop, y, -np.inf, 0.0, flow))
                return {"loglik": -np.inf, "steps": steps, "failed_at": stop, "env": env}
            w = np.exp(logw - top)
            score = top + math.log(w.mean())
            total += score
            w /= w.sum()
            ess = 1 / float((w * w).sum())
            pick = np.arange(particles) if np.ptp(logw) == 0 else systematic(w, rng.random())
            if record:
                draws = rng.poisson(np.maximum(parameters[self.reporting] * flow, 0)) if self.size is None else rng.poisson(rng.gamma(parameters[self.size], np.maximum(parameters[self.reporting] * flow, 1e-12) / parameters[self.size]))
                steps.append((stop, y, score, ess, draws))
                kept.append({c: v.copy() for c, v in state.items()})
                ancestors.append(pick)
            else:
                steps.append((stop, y, score, ess, None))
            state = {c: v[pick] for c, v in state.items()}
            if perturb:
                env = {n: v[pick] for n, v in env.items()}
        return {"loglik": total, "steps": steps, "failed_at": None, "env": env, "ancestors": ancestors, "states": kept}


def _seeded(*key: int):
    import numpy as np

    return np.random.default_rng([int(k) & (2**63 - 1) for k in key])


def _parameters(row, model: Model) -> dict:
    return {p: float(getattr(row, p)) for p in model.parameters}


def loglik_grid(points: DataFrame, filt: Filter, particles: int) -> DataFrame:
    """(points' columns, loglik, min_ess, failed_at) of every row (point x replicate, with ``seed``)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema] + ["loglik double", "min_ess double", "failed_at double"])

    def run(batches):
        for pdf in batches:
            found = [filt.run(_parameters(r, filt.model), particles, _seeded(r.seed, 7)) for r in pdf.itertuples(index=False)]
            yield pdf.assign(loglik=[f["loglik"] for f in found], min_ess=[min((s[3] for s in f["steps"]), default=float("nan")) for f in found], failed_at=[f["failed_at"] for f in found]).astype({"failed_at": "float64"})

    return points.mapInPandas(run, schema)


def prequential(points: DataFrame, filt: Filter, particles: int, key: str = "point_id") -> DataFrame:
    """One row per point and observation: log score, ESS, predictive quantiles, fair CRPS and PIT."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rng = _seeded(r.seed, 7)
                for t, y, score, ess, x in filt.run(_parameters(r, filt.model), particles, rng, record=True)["steps"]:
                    if y is None:
                        continue
                    x = np.sort(np.asarray(x, float))
                    n = len(x)
                    crps = np.abs(x - y).mean() - (2 * np.arange(1, n + 1) - n - 1) @ x / (n * (n - 1))
                    v = _seeded(r.seed, 11, int(round(t * 1e6))).random()
                    rows.append((getattr(r, key), t, y, score, ess, *np.quantile(x, (0.05, 0.25, 0.5, 0.75, 0.95)), crps, (x < y).mean() + v * (x == y).mean()))
            yield pd.DataFrame(rows, columns=[key, "t", "y_obs", "log_score", "ess", "q05", "q25", "q50", "q75", "q95", "crps", "pit"])

    return points.mapInPandas(run, f"`{key}` long, t double, y_obs double, log_score double, ess double, q05 double, q25 double, q50 double, q75 double, q95 double, crps double, pit double")


def profile(evaluated: DataFrame, cell: list[str]) -> DataFrame:
    """The best start of each profile cell and its distance from the best cell."""
    best = evaluated.groupBy(*cell).agg(F.max("loglik").alias("loglik"), F.max_by("start", "loglik").alias("best_start"))
    top = evaluated.agg(F.max("loglik").alias("top"))
    return best.join(F.broadcast(top)).withColumn("delta", F.col("loglik") - F.col("top")).drop("top")


def _unconstrained(x, lo: float, hi: float):
    return math.log((x - lo) / (hi - x))


def _natural(z, lo: float, hi: float):
    import numpy as np

    return lo + (hi - lo) / (1 + np.exp(-z))


def iterated_filtering(chains: DataFrame, filt: Filter, bounds: dict[str, tuple[float, float]], particles: int, iterations: int, sd: float = 0.1, cooling: float = 0.95) -> DataFrame:
    """IF2, one chain per row: (chain, iteration, loglik, parameters); the walk's size falls geometrically."""
    names = sorted(bounds)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                now, rng = _parameters(r, filt.model), _seeded(r.seed, 13)
                cloud = {n: np.full(particles, _unconstrained(now[n], *bounds[n])) for n in names}
                for it in range(iterations):
                    size = sd * cooling**it

                    def perturb(env, k, cloud=cloud, size=size):
                        moved = {n: (np.log((env[n] - bounds[n][0]) / (bounds[n][1] - env[n])) if k else cloud[n]) + rng.normal(0, size, particles) for n in names}
                        return env | {n: np.clip(_natural(z, *bounds[n]), bounds[n][0] * (1 + 1e-12) + 1e-300, bounds[n][1] * (1 - 1e-12)) for n, z in moved.items()}

                    found = filt.run(now, particles, rng, perturb=perturb)
                    if np.isfinite(found["loglik"]):
                        cloud = {n: np.log((found["env"][n] - bounds[n][0]) / (bounds[n][1] - found["env"][n])) for n in names}
                    now |= {n: float(_natural(cloud[n].mean(), *bounds[n])) for n in names}
                    rows.append((r.chain, it, found["loglik"], *[now[n] for n in names]))
            yield pd.DataFrame(rows, columns=["chain", "iteration", "loglik", *names])

    return chains.mapInPandas(run, "chain long, iteration long, loglik double, " + ", ".join(f"`{n}` double" for n in names))


def metropolis(chains: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], loglik: Callable, draws: int, burn: int, log_prior: Callable | None = None, scale: float = 0.3) -> DataFrame:
    """Adaptive random walk on the unconstrained scale, one chain per row: (chain, draw, loglik, accepted, parameters).

    ``loglik(parameters, rng)`` may be exact or a filter's estimate (then this is particle marginal Metropolis-Hastings).
    The proposal's covariance adapts during burn-in only.
    """
    names = sorted(bounds)

    def run(batches):
        import numpy as np
        import pandas as pd

        def target(z, base, rng):
            x = {n: float(_natural(v, *bounds[n])) for n, v in zip(names, z, strict=True)}
            jac = sum(-abs(v) - 2 * math.log1p(math.exp(-abs(v))) for v in z)
            ll = loglik(base | x, rng)
            return ll, ll + jac + (log_prior(x) if log_prior else 0.0), x

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                base, rng = _parameters(r, model), _seeded(r.seed, 17)
                z = np.array([_unconstrained(base[n], *bounds[n]) for n in names])
                ll, lp, x = target(z, base, rng)
                cov, seen = np.eye(len(names)) * scale**2, [z]
                for i in range(-burn, draws):
                    if i < 0 and len(seen) > 50 and len(seen) % 25 == 0:
                        cov = 2.38**2 / len(names) * np.cov(np.array(seen[len(seen) // 2 :]).T).reshape(len(names), -1) + 1e-8 * np.eye(len(names))
                    step = z + rng.multivariate_normal(np.zeros(len(names)), cov)
                    ll2, lp2, x2 = target(step, base, rng)
                    ok = np.log(rng.random()) < lp2 - lp
                    if ok:
                        z, ll, lp, x = step, ll2, lp2, x2
                    seen.append(z)
                    if i >= 0:
                        rows.append((r.chain, i, ll, bool(ok), *[x[n] for n in names]))
            yield pd.DataFrame(rows, columns=["chain", "draw", "loglik", "accepted", *names])

    return chains.mapInPandas(run, "chain long, draw long, loglik double, accepted boolean, " + ", ".join(f"`{n}` double" for n in names))


def nelder_mead(starts: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], objective: Callable, evaluations: int = 400, tolerance: float = 1e-8) -> DataFrame:
    """Simplex search from every start: (chain, loglik, evaluations, parameters)."""
    names = sorted(bounds)

    def search(f, z, size=0.5):
        import numpy as np

        pts = [z, *[z + size * np.eye(len(z))[i] for i in range(len(z))]]
        val, n = [f(p) for p in pts], len(pts)
        while n < evaluations:
            order = np.argsort(val)
            pts, val = [pts[i] for i in order], [val[i] for i in order]
            if abs(val[-1] - val[0]) < tolerance and max(np.abs(p - pts[0]).max() for p in pts) < 1e-6:
                break
            mid = np.mean(pts[:-1], axis=0)
            up = mid + (mid - pts[-1])
            fu = f(up)
            n += 1
            if fu < val[0]:
                far = mid + 2 * (mid - pts[-1])
                ff = f(far)
                n += 1
                pts[-1], val[-1] = (far, ff) if ff < fu else (up, fu)
            elif fu < val[-2]:
                pts[-1], val[-1] = up, fu
            else:
                near = mid + 0.5 * ((up if fu < val[-1] else pts[-1]) - mid)
                fn = f(near)
                n += 1
                if fn < min(fu, val[-1]):
                    pts[-1], val[-1] = near, fn
                else:
                    pts = [pts[0], *[pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]]
                    val = [val[0], *[f(p) for p in pts[1:]]]
                    n += len(pts) - 1
        best = min(range(len(val)), key=val.__getitem__)
        return pts[best], val[best], n

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                base = _parameters(r, model)

                def cost(z, base=base):
                    v = -objective(base | {n: float(_natural(x, *bounds[n])) for n, x in zip(names, z, strict=True)}, None)
                    return v if np.isfinite(v) else 1e300

                z, v, n = search(cost, np.array([_unconstrained(base[k], *bounds[k]) for k in names]))
                rows.append((r.chain, -v, n, *[float(_natural(x, *bounds[k])) for k, x in zip(names, z, strict=True)]))
            yield pd.DataFrame(rows, columns=["chain", "loglik", "evaluations", *names])

    return starts.mapInPandas(run, "chain long, loglik double, evaluations long, " + ", ".join(f"`{n}` double" for n in names))


def ode_loglik(model: Model, series: Series, flow: str, start: float, dt: float, reporting: str, size: str | None = None) -> Callable:
    """Exact log likelihood of a deterministic path: Runge-Kutta flows per window against the observations."""
    rates = [compile_rate(t.rate) for t in model.transitions]
    bindings = {n: compile_rate(e) for n, e in model.bindings.items()}
    initial = {c: compile_rate(e) for c, e in model.initial.items()}
    k = [t.name for t in model.transitions].index(flow)
    at = {c: i for i, c in enumerate(model.compartments)}

    def value(parameters: dict, rng=None) -> float:
        import numpy as np

        x = np.array([float(initial[c](parameters)) if c in initial else 0.0 for c in model.compartments] + [0.0])

        def slope(t, s):
            env = {**parameters, **{c: s[i] for c, i in at.items()}, "t": t, "dt": dt}
            for n, f in bindings.items():
                env[n] = f(env)
            out = np.zeros_like(s)
            for i, (tr, f) in enumerate(zip(model.transitions, rates, strict=True)):
                v = float(f(env))
                if tr.source:
                    out[at[tr.source]] -= v
                if tr.target:
                    out[at[tr.target]] += v
                if i == k:
                    out[-1] += v
            return out

        t, total = start, 0.0
        for stop, y in series:
            x[-1] = 0.0
            n = max(1, math.ceil((stop - t) / dt - 1e-9))
            h = (stop - t) / n
            for _ in range(n):
                k1 = slope(t, x)
                k2 = slope(t + h / 2, x + h / 2 * k1)
                k3 = slope(t + h / 2, x + h / 2 * k2)
                k4 = slope(t + h, x + h * k3)
                x, t = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), t + h
            t = stop
            if y is not None:
                mean = parameters[reporting] * x[-1]
                total += float(log_poisson(y, np.array(mean)) if size is None else log_negative_binomial(y, np.array(mean), parameters[size]))
        return total

    return value


def starts_within(spark, bounds: dict[str, tuple[float, float]], fixed: dict[str, float], n: int, seed: int) -> DataFrame:
    """Chains with starts from a Latin hypercube over the bounds, fixed parameters and a seed each."""
    from strataflow.plans.grid import latin_hypercube

    inner = {k: (lo + 0.02 * (hi - lo), hi - 0.02 * (hi - lo)) for k, (lo, hi) in bounds.items()}
    rows = latin_hypercube(spark, inner, n, seed).withColumnRenamed("point_id", "chain")
    return rows.withColumns({k: F.lit(float(v)) for k, v in fixed.items()}).withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "chain"), F.lit(2**53)))


def _chains(spark, n: int, seed: int, fixed: dict[str, float]) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("chain"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**53)).alias("seed"))
    return rows.withColumns({k: F.lit(float(v)) for k, v in fixed.items()})


def _uniform(seed: int, k: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("chain")), F.lit(2**52)) / 2.0**52


def starts_uniform(spark, bounds: dict[str, tuple[float, float]], fixed: dict[str, float], n: int, seed: int, log: tuple[str, ...] = ()) -> DataFrame:
    """Chains with starts spread evenly over the bounds, on a log scale for the parameters named in ``log``."""
    rows = _chains(spark, n, seed, fixed)
    for k, (name, (lo, hi)) in enumerate(sorted(bounds.items())):
        u = _uniform(seed, k)
        rows = rows.withColumn(name, F.exp(math.log(lo) + math.log(hi / lo) * u) if name in log else lo + (hi - lo) * u)
    return rows


def starts_unconstrained(spark, bounds: dict[str, tuple[float, float]], fixed: dict[str, float], n: int, seed: int, reach: float = 2.0) -> DataFrame:
    """Chains whose starts are even on the unconstrained scale of each interval, within ``reach`` of its middle."""
    rows = _chains(spark, n, seed, fixed)
    for k, (name, (lo, hi)) in enumerate(sorted(bounds.items())):
        z = (2 * _uniform(seed, k) - 1) * reach
        rows = rows.withColumn(name, lo + (hi - lo) / (1 + F.exp(-z)))
    return rows


def starts_at(spark, point: dict[str, float], n: int, seed: int) -> DataFrame:
    """Chains that all start at one point, with seeds of their own."""
    return _chains(spark, n, seed, point)


def starts_from(draws: DataFrame, names: list[str], n: int, seed: int, best: str | None = None) -> DataFrame:
    """Chains that start at n draws picked by a hash, or at the n draws with the largest ``best`` (a log likelihood)."""
    order = [F.desc(best)] if best else []
    rows = draws.orderBy(*order, F.xxhash64(F.lit(seed), *[F.col(c) for c in draws.columns])).limit(n)  # n is the number of chains
    chain = F.row_number().over(W.orderBy(*([F.desc("_b")] if best else []), *names)) - 1
    rows = rows.select(*names, *([F.col(best).alias("_b")] if best else [])).withColumn("chain", chain.cast("long")).select("chain", *names)
    return rows.withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "chain"), F.lit(2**53)))


def refuse_degenerate(evaluated: DataFrame, particles: int, share: float = 0.01) -> None:
    """Refuse a result in which a filter died or its least ESS is below a share of the particles."""
    bad = evaluated.where(F.col("failed_at").isNotNull() | (F.col("min_ess") < share * particles)).limit(1).collect()
    if bad:
        raise Refused(f"the filter degenerated: {bad[0].asDict()}")
