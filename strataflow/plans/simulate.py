"""Forward runs over a grid of cells: ODEs as recursive column expressions, stochastic models as grouped NumPy kernels.

A cell is one row of the grid with its parameters and its seed; cells are independent and spread over tasks.  The random
numbers of a cell come from its seed alone, so results don't depend on partitions or on other cells.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.checks import Refused, refuse_any
from strataflow.functions import expr as X
from strataflow.plans.grid import effect_step, n_substeps, step_end, step_length
from strataflow.plans.model import Model, branched, initial_order, largest_remainder, problems, refuse_unsupported

#: Above this chance of leaving in one step, a warning is due.
COARSE = 0.1


def _checked(model: Model, backend: str) -> Model:
    """The model in the form that backends run: one target per transition."""
    refuse_unsupported(model, backend)
    if found := problems(model):
        raise Refused("; ".join(found))
    return branched(model)


def whole(x):
    """Nearest whole numbers, halves away from zero (numpy)."""
    import numpy as np

    half = np.nextafter(0.5, 0.0)
    return np.trunc(x + np.copysign(half, x)).astype(np.int64)


#: Longest step of the deterministic integrator where a model has real compartments, and what rounding may leave of a compartment.
REAL_STEP = 0.5
BELOW_ZERO = -1e-6


def with_initial(cells: DataFrame, model: Model) -> DataFrame:
    """Adds one column per compartment: initial values in order of dependence, 0 where none is given."""
    names = [*model.parameters]
    for c in initial_order(model):
        cells = cells.withColumn(c, X.to_column(model.initial[c], X.Scope({n: F.col(n) for n in names})))
        names.append(c)
    return cells.withColumns({c: F.lit(0.0) for c in model.compartments if c not in model.initial})


def _slopes(model: Model, state: Column, t: Column, dt: Column) -> tuple[list[Column], list[Column]]:
    columns = {n: F.col(n) for n in model.parameters} | {c: state[c] for c in model.compartments} | {"t": t, "dt": dt}
    for name, e in model.bindings.items():
        columns[name] = X.to_column(e, X.Scope(columns))
    rates = [X.to_column(tr.rate, X.Scope(columns)) for tr in model.transitions]
    change = []
    for c in model.compartments:
        d = F.lit(0.0)
        for tr, r in zip(model.transitions, rates, strict=True):
            d = d + r if tr.target == c else d
            d = d - r if tr.source == c else d
        change.append(d)
    return change, rates


def ode(cells: DataFrame, model: Model, start: float, stop: float, dt: float, every: int = 1) -> DataFrame:
    """Fourth-order Runge-Kutta with a fixed step inside Catalyst: (cell columns, time, t_start, t_stop, compartments, flow_*).

    One row per cell folds over its steps and keeps every ``every``-th state; flows are summed since the last kept one.
    The last step is shortened to end with the run, and the end is kept whatever ``every`` is.  Effects of actions happen at the
    end of a step that is nearest to their time, then the balance is set.

    Real compartments are never below 0: each stage looks at them from 0 on, and so does the end of a step.  Where a model has
    some, steps are cut into parts of at most ``REAL_STEP``.  Any other compartment below 0 fails the job.
    """
    model = _checked(model, "ode")
    if model.real and dt > REAL_STEP:
        parts = math.ceil(dt / REAL_STEP)
        dt, every = dt / parts, every * parts
    steps = n_substeps(start, stop, dt)
    fields = [*model.compartments, *[f"flow_{t.name}" for t in model.transitions]]
    kind = "struct<" + ",".join(f"`{f}`:double" for f in fields) + ">"

    def held_up(name: str, v: Column) -> Column:
        return F.greatest(v, F.lit(0.0)) if name in model.real else v

    def ended(name: str, v: Column) -> Column:
        if name.startswith("flow_") or name in model.real or (model.balance and name == model.balance[0]):
            return held_up(name, v)
        return F.when(v < BELOW_ZERO, F.raise_error(F.concat(F.lit(f"compartment {name} fell below 0: "), v.cast("string"))).cast("double")).otherwise(v)

    def shifted(s: Column, k: Column, f: Column) -> Column:
        return F.struct(*[held_up(c, s[c] + f * k[c]).alias(c) for c in model.compartments])

    def stage(s: Column, t: Column, length: Column) -> Column:
        change, rates = _slopes(model, s, t, length)
        return F.struct(*[d.alias(c) for c, d in zip(model.compartments, change, strict=True)], *[r.alias(f"flow_{tr.name}") for tr, r in zip(model.transitions, rates, strict=True)])

    def let(value: Column, body) -> Column:
        """Names an intermediate result inside a lambda, so that it is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    due: dict[int, list] = {}
    for a in model.actions:
        for t in a.at:
            if (k := effect_step(t, start, stop, dt)) is not None:
                due.setdefault(k, []).append(a)

    def acted(s: Column, i: Column, t: Column, length: Column) -> Column:
        if not due and not model.balance:
            return s
        out = {f: s[f] for f in fields}
        for k, actions in due.items():
            for a in actions:
                hit = i == k
                if a.kind == "fraction":
                    moved = F.when(hit, out[a.source] * a.amount).otherwise(0.0)
                elif a.kind == "absolute":
                    moved = F.when(hit, F.least(F.lit(float(a.amount)), out[a.source])).otherwise(0.0)
                elif a.kind == "add":
                    out[a.target] = out[a.target] + F.when(hit, float(a.amount)).otherwise(0.0)
                    continue
                else:
                    out[a.target] = F.when(hit, F.lit(float(a.amount))).otherwise(out[a.target])
                    continue
                out[a.source] = out[a.source] - moved
                if a.target:
                    out[a.target] = out[a.target] + moved
        if model.balance:
            columns = {n: F.col(n) for n in model.parameters} | {c: out[c] for c in model.compartments} | {"t": t, "dt": length}
            for name, e in model.bindings.items():
                columns[name] = X.to_column(e, X.Scope(columns))
            out[model.balance[0]] = F.when(i > 0, X.to_column(model.balance[1], X.Scope(columns))).otherwise(out[model.balance[0]])
        return F.struct(*[v.alias(f) for f, v in out.items()]).cast(kind)

    def end(i: Column) -> Column:
        return F.when(i == steps, F.lit(float(stop))).otherwise(F.lit(float(start)) + i * dt)

    def step(acc: Column, i: Column) -> Column:
        s, t = acc["s"], F.lit(float(start)) + i * dt
        length = F.when(i == steps - 1, F.lit(float(step_length(steps - 1, start, stop, dt)))).otherwise(F.lit(float(dt)))

        def finish(k1: Column, k2: Column, k3: Column, k4: Column) -> Column:
            new = F.struct(*[ended(f, s[f] + length / 6 * (k1[f] + 2 * k2[f] + 2 * k3[f] + k4[f])).alias(f) for f in fields]).cast(kind)
            return let(new, lambda n: let(acted(n, i + 1, end(i + 1), length), kept))

        def kept(n: Column) -> Column:
            """After the actions of the step, an output appends the state and lets the flows start again."""
            keep = ((i + 1) % every == 0) | (i == steps - 1)
            row = F.struct(end(i + 1).alias("time"), *[n[f].alias(f) for f in fields])
            reset = F.struct(*[(F.when(keep, 0.0).otherwise(n[f]) if f.startswith("flow_") else n[f]).alias(f) for f in fields]).cast(kind)
            return F.struct(reset.alias("s"), F.when(keep, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

        half = length / 2
        return let(stage(s, t, length), lambda k1: let(stage(shifted(s, k1, half), t + half, length), lambda k2: let(stage(shifted(s, k2, half), t + half, length), lambda k3: let(stage(shifted(s, k3, length), t + length, length), lambda k4: finish(k1, k2, k3, k4)))))

    rows = with_initial(cells, model)
    first = F.struct(*[F.col(c).cast("double").alias(c) for c in model.compartments], *[F.lit(0.0).alias(f"flow_{t.name}") for t in model.transitions]).cast(kind)
    rows = rows.withColumn("_first", acted(first, F.lit(0), F.lit(float(start)), F.lit(float(dt))))
    first = F.col("_first")
    held = F.struct(F.lit(float(start)).alias("time"), *[first[f].alias(f) for f in fields])
    zero = F.struct(first.alias("s"), F.array(held).alias("out"))
    path = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), zero, step, lambda acc: acc["out"]) if steps else F.array(held)
    out = rows.select(*cells.columns, F.posexplode(path).alias("_k", "p")).select(*cells.columns, "p.*", "_k")
    # Flows count from the output before.
    return out.withColumn("t_start", start + F.greatest(F.col("_k") - 1, F.lit(0)) * (dt * every)).withColumn("t_stop", F.col("time")).drop("_k")


def compile_rate(e: X.Expr):
    """A NumPy function of a dict of arrays."""
    import numpy as np

    a = [compile_rate(x) for x in e.args]
    two = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide, "pow": np.power, "min": np.minimum, "max": np.maximum, "lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "eq": np.equal, "ne": np.not_equal}
    one = {"neg": np.negative, "exp": np.exp, "log": np.log, "sqrt": np.sqrt, "abs": np.abs, "floor": np.floor, "ceil": np.ceil, "sin": np.sin, "cos": np.cos, "tanh": np.tanh, "unchecked": lambda x: x}
    if e.op == "const":
        return lambda env, v=float(e.value): v
    if e.op == "ref":
        return lambda env, n=e.value: env[n]
    if e.op in two:
        return lambda env, f=two[e.op]: f(a[0](env), a[1](env)) * 1.0
    if e.op == "mod":
        return lambda env: np.mod(a[0](env), np.abs(a[1](env)))
    if e.op in one:
        return lambda env, f=one[e.op]: f(a[0](env))
    if e.op == "sum":
        return lambda env: sum(f(env) for f in a)
    if e.op == "cond":
        return lambda env: np.where(a[0](env) > 0, a[1](env), a[2](env))
    raise Refused(f"{e.op} can't run in a kernel")


class Kernel:
    """A step of the chain-binomial process for many particles or cells at once (arrays of one value per member)."""

    def __init__(self, model: Model):
        self.model = model = branched(model)
        self.balance = (model.balance[0], compile_rate(model.balance[1])) if model.balance else None
        self.rates = [compile_rate(t.rate) for t in model.transitions]
        self.bindings = {n: compile_rate(e) for n, e in model.bindings.items()}
        self.exits = {c: [i for i, t in enumerate(model.transitions) if t.source == c] for c in model.compartments}

    def environment(self, state: Mapping, parameters: Mapping, t: float, dt: float) -> dict:
        env = {**parameters, **state, "t": t, "dt": dt}
        for n, f in self.bindings.items():
            env[n] = f(env)
        return env

    def propensities(self, state: Mapping, parameters: Mapping, t: float, dt: float, size: int):
        import numpy as np

        env = self.environment(state, parameters, t, dt)
        return [np.broadcast_to(np.asarray(r(env), float), (size,)) for r in self.rates]

    def step(self, state: dict, parameters: Mapping, t: float, dt: float, rng) -> list:
        """Draw all flows from the state at the start of the step, then apply them; returns the flows."""
        import numpy as np

        size = len(next(iter(state.values())))
        rates = self.propensities(state, parameters, t, dt, size)
        flows: list = [np.zeros(size, np.int64) for _ in rates]
        for i, tr in enumerate(self.model.transitions):
            if tr.overdispersion:
                shape = dt / tr.overdispersion
                rates[i] = rates[i] * rng.gamma(shape, 1 / shape, size)
        for c, exits in self.exits.items():
            n = state[c].astype(np.int64)
            for i in (i for i in exits if self.model.transitions[i].law == "deterministic"):
                flows[i] = np.minimum(whole(np.maximum(rates[i], 0) * dt), n)
                n = n - flows[i]
            drawn = [i for i in exits if self.model.transitions[i].law != "deterministic"]
            if not drawn:
                continue
            # One draw for all who leave, which is then split between the exits one after another.
            each = [np.maximum(rates[i], 0) / np.maximum(state[c], 1) for i in drawn]
            total = sum(each)
            gone = rng.binomial(n, -np.expm1(-total * dt))
            for i, r in zip(drawn[:-1], each[:-1], strict=True):
                share = np.divide(r, total, out=np.zeros(size), where=total > 0)
                flows[i] = rng.binomial(gone, np.clip(share, 0, 1))
                gone, total = gone - flows[i], total - r
            flows[drawn[-1]] = gone
        for i, tr in enumerate(self.model.transitions):
            if tr.source is None:
                mean = np.maximum(rates[i], 0) * dt
                flows[i] = whole(mean) if tr.law == "deterministic" else rng.poisson(mean)
        for f, tr in zip(flows, self.model.transitions, strict=True):
            if tr.source:
                state[tr.source] = state[tr.source] - f
            if tr.target:
                state[tr.target] = state[tr.target] + f
        for c in self.model.compartments:
            if (state[c] < 0).any():
                raise ValueError(f"{c} fell below 0")
        return flows

    def act(self, state: dict, due, parameters: Mapping, t: float, dt: float, balance: bool = True) -> None:
        """The actions that ``due`` names, in order of declaration, then the balance."""
        import numpy as np

        for a in (a for a in self.model.actions if a.name in due):
            if a.kind == "grouped":
                held = np.stack([state[c] for c in a.sources])
                for j in range(held.shape[1]):
                    for c, n in zip(a.sources, largest_remainder(int(min(a.amount, held[:, j].sum())), list(held[:, j])), strict=True):
                        state[c][j] -= n
                        if a.target:
                            state[a.target][j] += n
                continue
            if a.kind in ("fraction", "absolute"):
                n = np.floor(state[a.source] * a.amount).astype(np.int64) if a.kind == "fraction" else np.minimum(whole(a.amount), state[a.source])
                state[a.source] = state[a.source] - n
                if a.target:
                    state[a.target] = state[a.target] + n
            elif a.kind == "set":
                state[a.target] = np.full_like(state[a.target], whole(a.amount))
            else:
                state[a.target] = np.maximum(state[a.target] + whole(a.amount), 0)
        if self.balance and balance:
            target, value = self.balance
            state[target] = np.broadcast_to(whole(np.asarray(value(self.environment(state, parameters, t, dt)), float)), state[target].shape).copy()


def schedule(model: Model, start: float, stop: float, dt: float) -> dict[int, set[str]]:
    """Names of the actions that are due at the end of each step (0: the start of the run)."""
    due: dict[int, set[str]] = {}
    for a in model.actions:
        for t in a.at:
            if (k := effect_step(t, start, stop, dt)) is not None:
                due.setdefault(k, set()).add(a.name)
    return due


def scalar_source(e: X.Expr) -> str:
    """Python source of a rate for single numbers; it gives the values of :func:`compile_rate`."""
    a = [scalar_source(x) for x in e.args]
    infix = {"add": "+", "sub": "-", "mul": "*"}
    tests = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}
    if e.op == "const":
        return repr(float(e.value))
    if e.op == "ref":
        return f"v_{e.value}"
    if e.op in infix:
        return f"({a[0]} {infix[e.op]} {a[1]})"
    if e.op in tests:
        return f"(1.0 if {a[0]} {tests[e.op]} {a[1]} else 0.0)"
    if e.op == "neg":
        return f"(-{a[0]})"
    if e.op == "unchecked":
        return a[0]
    if e.op == "sum":
        return "(" + " + ".join(a or ["0.0"]) + ")"
    if e.op == "cond":
        return f"({a[1]} if {a[0]} > 0 else {a[2]})"
    # The rest has its edges in NumPy.
    names = {"div": "divide", "pow": "power", "min": "minimum", "max": "maximum", "abs": "absolute"}
    if e.op == "mod":
        return f"float(np.mod({a[0]}, abs({a[1]})))"
    if e.op == "div":
        return f"({a[0]} / {a[1]} if {a[1]} else float(np.divide({a[0]}, {a[1]})))"
    if e.op in ("pow", "min", "max", "exp", "log", "sqrt", "abs", "floor", "ceil", "sin", "cos", "tanh"):
        return f"float(np.{names.get(e.op, e.op)}({', '.join(a)}))"
    raise Refused(f"{e.op} can't run in a kernel")


class CellKernel:
    """The chain-binomial step of one cell, on plain numbers: arrays of length one cost more than the work in them.

    The model's rates become one Python function.  Draws are those of :class:`Kernel` for one member.
    """

    def __init__(self, model: Model):
        import numpy as np

        self.model = model = branched(model)
        at = {c: i for i, c in enumerate(model.compartments)}
        self.ends = [(at.get(t.source), at.get(t.target)) for t in model.transitions]
        self.exits = [(at[c], [i for i, t in enumerate(model.transitions) if t.source == c and t.law == "deterministic"], [i for i, t in enumerate(model.transitions) if t.source == c and t.law != "deterministic"]) for c in model.compartments if any(t.source == c for t in model.transitions)]
        self.inflows = [(i, t.law == "deterministic") for i, t in enumerate(model.transitions) if t.source is None]
        self.spread = [(i, t.overdispersion) for i, t in enumerate(model.transitions) if t.overdispersion]
        lines = ["def rates(state, p, t, dt):", *[f"    v_{c} = float(state[{i}])" for c, i in at.items()], *[f"    v_{n} = p[{n!r}]" for n in model.parameters], "    v_t, v_dt = t, dt"]
        lines += [f"    v_{n} = {scalar_source(e)}" for n, e in model.bindings.items()]
        balance = [f"    return {scalar_source(model.balance[1])}"] if model.balance else ["    return None"]
        space: dict = {"np": np}
        exec("\n".join([*lines, "    return [" + ", ".join(scalar_source(t.rate) for t in model.transitions) + "]"]), space)
        self.rates = space["rates"]
        exec("\n".join([*lines, *balance]), space)
        self.balance = (at[model.balance[0]], space["rates"]) if model.balance else None
        self.array = Kernel(model)

    def step(self, state: list, p: dict, t: float, dt: float, rng) -> list:
        """Draw all flows from the state at the start of the step, then apply them; returns the flows."""
        rates = self.rates(state, p, t, dt)
        for i, sigma in self.spread:
            rates[i] *= rng.gamma(dt / sigma, sigma / dt)
        flows = [0] * len(rates)
        for c, fixed, drawn in self.exits:
            n = state[c]
            for i in fixed:
                flows[i] = min(_whole(max(rates[i], 0.0) * dt), n)
                n -= flows[i]
            if not drawn or n <= 0:
                continue
            each = [max(rates[i], 0.0) / max(state[c], 1) for i in drawn]
            total = sum(each)
            gone = int(rng.binomial(n, -math.expm1(-total * dt))) if total > 0 else 0
            for i, r in zip(drawn[:-1], each[:-1], strict=True):
                flows[i] = int(rng.binomial(gone, min(max(r / total, 0.0), 1.0))) if gone and total > 0 else 0
                gone, total = gone - flows[i], total - r
            flows[drawn[-1]] = gone
        for i, fixed in self.inflows:
            mean = max(rates[i], 0.0) * dt
            flows[i] = _whole(mean) if fixed else int(rng.poisson(mean))
        for f, (a, b) in zip(flows, self.ends, strict=True):
            if a is not None:
                state[a] -= f
            if b is not None:
                state[b] += f
        if min(state) < 0:
            raise ValueError(f"{self.model.compartments[state.index(min(state))]} fell below 0")
        return flows

    def act(self, state: list, due, p: dict, t: float, dt: float, balance: bool = True) -> None:
        if due:
            import numpy as np

            arrays = {c: np.array([n], np.int64) for c, n in zip(self.model.compartments, state, strict=True)}
            self.array.act(arrays, due, p, t, dt, balance=False)
            state[:] = [int(arrays[c][0]) for c in self.model.compartments]
        if self.balance and balance:
            state[self.balance[0]] = _whole(self.balance[1](state, p, t, dt))


class _Watch:
    """The triggers of one cell's run: what they have seen, and which actions are due at the end of a step."""

    def __init__(self, model: Model, start: float, stop: float, dt: float):
        names = [t.name for t in model.transitions]
        self.span = start, stop, dt
        self.rules = [(a.name, a.trigger, names.index(a.trigger.flow)) for a in model.actions if a.trigger]
        self.sums = [0.0] * len(self.rules)
        self.seen: list[list[tuple[float, float]]] = [[] for _ in self.rules]
        self.next = [start + r[1].every for r in self.rules]
        self.last: dict[str, float] = {}
        self.waiting: dict[int, list[str]] = {}
        self.fired: list[str] = []

    def due(self, step: int, now: float, flows: list) -> list[str]:
        for k, (name, rule, flow) in enumerate(self.rules):
            self.sums[k] += flows[flow]
            if now < self.next[k] - 1e-9:
                continue
            self.seen[k].append((now, rule.reporting * self.sums[k]))
            self.sums[k], self.next[k] = 0.0, self.next[k] + rule.every
            values = [y for t, y in self.seen[k] if now - rule.window < t <= now + 1e-9]
            value = self.seen[k][-1][1] if rule.fold == "latest" else 0.0 if not values else sum(values) if rule.fold == "sum" else max(values) if rule.fold == "max" else sum(values) / len(values)
            ready = name not in self.last or (not rule.once and now - self.last[name] >= rule.cooldown - 1e-9)
            if value >= rule.threshold and ready:
                self.last[name] = now
                at = effect_step(now + rule.delay, *self.span)
                if at is not None:
                    self.waiting.setdefault(max(at, step), []).append(name)
        self.fired = self.waiting.pop(step, [])
        return self.fired


def _whole(x: float) -> int:
    """:func:`whole` for one number."""
    return int(math.copysign(math.floor(abs(x) + math.nextafter(0.5, 0.0)), x))


def _run(cells: DataFrame, model: Model, run, partitions: int | None) -> DataFrame:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema]
    paths = ["time double", "t_start double", "t_stop double", *[f"`{c}` long" for c in model.compartments], *[f"`flow_{t.name}` long" for t in model.transitions]]
    rows = with_initial(cells, model)
    rows = rows.repartition(partitions, "cell") if partitions else rows
    names = cells.columns

    def batches(it):
        import pandas as pd

        for pdf in it:
            # One frame for all cells of a batch.
            own, found = [], []
            for k, r in enumerate(pdf.itertuples(index=False)):
                path = run(r, {p: float(getattr(r, p)) for p in model.parameters})
                own += [k] * len(path)
                found += path
            head = pdf[names].iloc[own].reset_index(drop=True)
            yield pd.concat([head, pd.DataFrame(found, columns=[x.split()[0].strip("`") for x in paths])], axis=1)

    return rows.mapInPandas(batches, ", ".join([*kinds, *paths]))


def chain_binomial(cells: DataFrame, model: Model, start: float, stop: float, dt: float, every: int = 1, partitions: int | None = None, firings: bool = False) -> DataFrame:
    """Stochastic trajectories of every cell (column ``seed`` needed): compartments and flows since the last output.

    With ``firings`` the same runs give the log of their reactive actions instead.
    """
    model = _checked(model, "chain_binomial")
    steps, due = n_substeps(start, stop, dt), schedule(model, start, stop, dt)
    clock = [(step_end(i, start, stop, dt), step_length(i, start, stop, dt), step_end(i + 1, start, stop, dt)) for i in range(steps)]
    kernels: list[CellKernel] = []

    def run(r, parameters, fired=None):
        import numpy as np

        if not kernels:
            kernels.append(CellKernel(model))
        kernel, rng = kernels[0], np.random.default_rng([int(r.seed), 1])
        state = [_whole(float(getattr(r, c))) for c in model.compartments]
        sums, rows, before = [0] * len(model.transitions), [], start
        watch = _Watch(model, start, stop, dt)
        kernel.act(state, due.get(0, ()), parameters, start, dt, balance=False)
        rows.append((start, start, start, *state, *sums))
        for i, (begin, length, now) in enumerate(clock):
            flows = kernel.step(state, parameters, begin, length, rng)
            sums = [a + f for a, f in zip(sums, flows, strict=True)]
            kernel.act(state, {*due.get(i + 1, ()), *watch.due(i + 1, now, flows)}, parameters, now, length)
            if fired is not None:
                fired.extend((name, now, i + 1) for name in watch.fired)
            if (i + 1) % every == 0 or i + 1 == steps:
                rows.append((now, before, now, *state, *sums))
                sums, before = [0] * len(sums), now
        return rows

    if firings:
        return _firings(cells, model, run)
    return _run(cells, model, run, partitions)


def _firings(cells: DataFrame, model: Model, run) -> DataFrame:
    """(cell columns, name, time, step) of the reactive actions of every cell."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema]
    names = cells.columns

    def batches(it):
        import pandas as pd

        for pdf in it:
            own, found = [], []
            for k, r in enumerate(pdf.itertuples(index=False)):
                fired: list = []
                run(r, {p: float(getattr(r, p)) for p in model.parameters}, fired)
                own += [k] * len(fired)
                found += fired
            yield pd.concat([pdf[names].iloc[own].reset_index(drop=True), pd.DataFrame(found, columns=["name", "time", "step"])], axis=1)

    return with_initial(cells, model).mapInPandas(batches, ", ".join([*kinds, "name string, time double, step long"]))


def gillespie(cells: DataFrame, model: Model, start: float, stop: float, every: float, partitions: int | None = None) -> DataFrame:
    """Exact event-by-event trajectories; output times, actions and the end are hit exactly."""
    model = _checked(model, "gillespie")
    n_out = math.floor((stop - start) / every + 1e-9)
    stops = sorted([(t, 0, a.name) for a in model.actions for t in a.at if start <= t <= stop] + [(start + i * every, 1, "") for i in range(n_out + 1)], key=lambda x: x[:2])
    kernels: list[CellKernel] = []

    def run(r, parameters):
        import numpy as np

        if not kernels:
            kernels.append(CellKernel(model))
        kernel, rng = kernels[0], np.random.default_rng([int(r.seed), 2])
        state = [_whole(float(getattr(r, c))) for c in model.compartments]
        t, before, sums, rows = start, start, [0] * len(model.transitions), []
        for at, kind, name in stops:
            while t < at:
                # A transition whose source is empty can't happen.
                rates = [x if x > 0 and (a is None or state[a] > 0) else 0.0 for x, (a, _) in zip(kernel.rates(state, parameters, t, 0.0), kernel.ends, strict=True)]
                total = sum(rates)
                wait = rng.exponential(1 / total) if total > 0 else math.inf
                if t + wait > at:
                    break
                t += wait
                u, i = rng.random() * total, 0
                while i < len(rates) - 1 and u >= rates[i]:
                    u -= rates[i]
                    i += 1
                sums[i] += 1
                a, b = kernel.ends[i]
                if a is not None:
                    state[a] -= 1
                if b is not None:
                    state[b] += 1
            t = at
            if kind:
                rows.append((at, before, at, *state, *sums))
                sums, before = [0] * len(sums), at
            else:
                kernel.act(state, {name}, parameters, at, 0.0)
        return rows

    return _run(cells, model, run, partitions)


def event_log(paths: DataFrame, model: Model, keys: list[str], start: float, dt: float) -> DataFrame:
    """The counted events of trajectories that keep every step: keys, time, transition (its number), multiplicity, batched and step.

    Events of one step are a batch: they were drawn together from the state before it.
    """
    names = [t.name for t in branched(model).transitions]
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"flow_{n}", i)])
    rows = paths.where(F.col("time") > start).unpivot([*keys, "time", "t_start"], [f"flow_{n}" for n in names], "flow", "multiplicity").where(F.col("multiplicity") > 0)
    step = F.round((F.col("t_start") - start) / dt).cast("long")
    return rows.select(*keys, "time", number[F.col("flow")].alias("transition"), F.col("multiplicity").cast("long").alias("multiplicity"), F.lit(True).alias("batched"), step.alias("step"), F.lit(None).cast("array<double>").alias("lineage_weights"))


def resume(cells: DataFrame, states: DataFrame, keys: list[str], model: Model, at: float) -> tuple[DataFrame, Model]:
    """Cells that go on from stored states (keys, time, compartments) instead of the model's initial values.

    A cell without a state, or with one of another time than ``at``, is refused.
    """
    both = cells.join(states.select(*keys, F.col("time").alias("_time"), *[F.col(c).cast("double").alias(f"from_{c}") for c in model.compartments]), keys, "left")
    refuse_any(both.where(F.col("_time").isNull() | (F.abs(F.col("_time") - at) > 1e-9)), "a cell has no state at the time of the restart")
    go_on = replace(model, parameters=(*model.parameters, *[f"from_{c}" for c in model.compartments]), initial={c: X.ref(f"from_{c}") for c in model.compartments})
    return both.drop("_time"), go_on


def coarse_steps(paths: DataFrame, model: Model, dt: float, keys: list[str]) -> DataFrame:
    """Largest rate times dt per source and cell where it passes the warning level."""
    scope = X.Scope({n: F.col(n) for n in (*model.parameters, *model.compartments)} | {"t": F.col("time"), "dt": F.lit(dt)}, mode="zero")
    for n, e in model.bindings.items():
        scope.columns[n] = X.to_column(e, scope)
    tops = []
    for c in model.compartments:
        exits = [X.to_column(t.rate, scope) for t in model.transitions if t.source == c]
        if exits:
            tops.append(F.struct(F.lit(c).alias("source"), F.max(sum(exits[1:], exits[0]) * dt / F.greatest(F.col(c), F.lit(1))).alias("chance")))
    return paths.groupBy(*keys).agg(F.array(*tops).alias("a")).select(*keys, F.explode("a").alias("x")).select(*keys, "x.*").where(F.col("chance") > COARSE)


def observe(paths: DataFrame, column: str, family: str, reporting: float, dispersion: float = 0.0, seed: str = "seed") -> DataFrame:
    """Synthetic observations of a flow; their random numbers come from the seed and the time, apart from the process's."""

    def draw(it):
        import numpy as np

        for pdf in it:
            out = []
            for s, t, x in zip(pdf[seed], pdf["time"], pdf[column], strict=True):
                rng = np.random.default_rng([int(s) ^ 0x5EED, int(round(t * 1e6)) & (2**63 - 1)])
                mean = reporting * x
                if family == "binomial":
                    out.append(rng.binomial(int(x), reporting))
                elif family == "negative_binomial":
                    out.append(rng.poisson(rng.gamma(dispersion, mean / dispersion)) if mean > 0 else 0)
                else:
                    out.append(rng.poisson(mean))
            pdf["observed"] = np.array(out, np.int64)
            yield pdf

    return paths.mapInPandas(draw, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema) + ", observed long")
