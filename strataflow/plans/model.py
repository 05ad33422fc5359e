"""A declarative compartmental model and its checks.  Dimensions stay keys; nothing is expanded into text."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from strataflow.checks import Refused
from strataflow.functions import expr as X


@dataclass(frozen=True)
class Transition:
    """``rate`` is the total rate; a source gives exits, no source an inflow; ``law`` is how the count is drawn.

    ``branches`` are (target, weight) pairs of a flow that splits; ``overdispersion`` is the variance of a gamma factor of
    mean 1 on the rate.
    """

    name: str
    source: str | None
    target: str | None
    rate: X.Expr
    law: str = "stochastic"
    overdispersion: float = 0.0
    branches: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Trigger:
    """Fires when what is observed of a flow reaches a threshold.

    Every ``every`` time units the flow since the last look, times ``reporting``, is one observed value.  ``fold`` (sum, mean, max or
    latest) takes the values of (now - window, now]; none of them gives 0.  The action follows ``delay`` later; with ``once``
    it comes a single time, else not before ``cooldown`` has passed since it last fired.
    """

    flow: str
    every: float
    threshold: float
    reporting: float = 1.0
    fold: str = "sum"
    window: float = math.inf
    delay: float = 0.0
    once: bool = False
    cooldown: float = 0.0


@dataclass(frozen=True)
class Action:
    """fraction, absolute, set or add on compartments at given times, or grouped: a total shared by largest remainders.

    With a trigger the action has no times of its own.
    """

    name: str
    kind: str
    at: tuple[float, ...]
    amount: float
    source: str | None = None
    target: str | None = None
    sources: tuple[str, ...] = ()
    trigger: Trigger | None = None


@dataclass(frozen=True)
class Model:
    compartments: tuple[str, ...]
    parameters: tuple[str, ...]
    transitions: tuple[Transition, ...]
    initial: Mapping[str, X.Expr] = field(default_factory=dict)
    real: tuple[str, ...] = ()
    actions: tuple[Action, ...] = ()
    bindings: Mapping[str, X.Expr] = field(default_factory=dict)
    #: A compartment and the value that it is set to at the end of every step, so that a budget holds.
    balance: tuple[str, X.Expr] | None = None


def staged(model: Model, compartment: str, stages: int, exit_name: str) -> Model:
    """Split a compartment into stages passed one after another (an Erlang stay of the same mean).

    The named exit becomes the exit of the last stage at ``stages`` times its rate; other exits leave from every stage.
    """
    names = [f"{compartment}_{i + 1}" for i in range(stages)]
    whole = X.call("sum", *[X.ref(n) for n in names])

    def swap(e: X.Expr, by: X.Expr) -> X.Expr:
        if e == X.ref(compartment):
            return by
        return X.Expr(e.op, tuple(swap(a, by) for a in e.args), e.value)

    out: list[Transition] = []
    for t in model.transitions:
        target = names[0] if t.target == compartment else t.target
        if t.source != compartment:
            out.append(replace(t, target=target, rate=swap(t.rate, whole)))
            continue
        for i, n in enumerate(names):
            share = swap(t.rate, X.ref(n))
            if t.name == exit_name:
                out.append(replace(t, name=f"{t.name}_{i + 1}", source=n, target=names[i + 1] if i + 1 < stages else target, rate=share * stages))
            else:
                out.append(replace(t, name=f"{t.name}_{i + 1}", source=n, target=target, rate=share))
    at = model.compartments.index(compartment)
    initial = dict(model.initial)
    if compartment in initial:
        initial[names[0]] = initial.pop(compartment)
        initial |= {n: X.lift(0) for n in names[1:]}
    return replace(model, compartments=(*model.compartments[:at], *names, *model.compartments[at + 1 :]), transitions=tuple(out), initial=initial)


def branched(model: Model) -> Model:
    """Flows with branches become one transition per destination, by weight.  Every backend runs the model in this form."""
    out = []
    for t in model.transitions:
        total = sum(w for _, w in t.branches)
        out += [replace(t, name=f"{t.name}_{to}", target=to, rate=t.rate * (w / total), branches=()) for to, w in t.branches] or [t]
    return replace(model, transitions=tuple(out))


def initial_order(model: Model) -> list[str]:
    """Compartments in an order in which each initial value only needs those before it."""
    left, done = dict(model.initial), []
    while left:
        ready = [c for c, e in left.items() if not (X.references(e) & set(left)) - {c} and c not in X.references(e)]
        if not ready:
            raise Refused(f"initial values depend on each other: {sorted(left)}")
        for c in ready:
            del left[c]
        done += ready
    return done


def problems(model: Model) -> list[str]:
    """Names that repeat or don't resolve, illegal trees, unknown laws and actions."""
    out = []
    every = [*model.compartments, *model.parameters, *model.bindings]
    if len(set(every)) < len(every):
        out.append("a name is used twice")
    if len({t.name for t in model.transitions}) < len(model.transitions):
        out.append("a transition's name is used twice")
    names = {*every, "t", "dt"}
    for t in model.transitions:
        out += [f"{t.name}: {p}" for p in X.validate(t.rate, names)]
        out += [f"{t.name}: no compartment {c}" for c in (t.source, t.target, *[b for b, _ in t.branches]) if c and c not in model.compartments]
        if t.source is None and t.target is None:
            out.append(f"{t.name}: goes from nowhere to nowhere")
        if t.law not in ("stochastic", "deterministic", "poisson"):
            out.append(f"{t.name}: unknown law {t.law}")
    for c, e in model.initial.items():
        out += [f"{c}: {p}" for p in X.validate(e, names)]
    out += [f"no compartment {c}" for c in model.real if c not in model.compartments]
    if model.balance:
        c, e = model.balance
        out += [f"balance: {p}" for p in X.validate(e, names)] + ([f"balance: no compartment {c}"] if c not in model.compartments else [])
    for a in model.actions:
        if a.kind not in ("fraction", "absolute", "set", "add", "grouped"):
            out.append(f"{a.name}: unknown action {a.kind}")
        if a.trigger and (a.at or a.trigger.fold not in ("sum", "mean", "max", "latest") or a.trigger.every <= 0):
            out.append(f"{a.name}: a trigger needs a fold, a time between looks above 0, and no times beside it")
        if a.trigger and a.trigger.flow not in {t.name for t in branched(model).transitions}:
            out.append(f"{a.name}: no flow {a.trigger.flow}")
    return out


def lint(model: Model) -> list[str]:
    """Compartments that nothing moves, transitions that share rate and ends."""
    used = {c for t in model.transitions for c in (t.source, t.target, *[b for b, _ in t.branches])} | ({model.balance[0]} if model.balance else set()) | {c for a in model.actions for c in (a.source, a.target, *a.sources)}
    out = [f"{c} never changes" for c in model.compartments if c not in used]
    seen: dict = {}
    for t in model.transitions:
        if (t.source, t.target, t.rate) in seen:
            out.append(f"{t.name} repeats {seen[t.source, t.target, t.rate]}")
        seen[t.source, t.target, t.rate] = t.name
    return out


# Which features each backend can run.
BACKENDS = {
    "chain_binomial": {"overdispersion", "deterministic", "actions", "reactive", "grouped", "balance"},
    "gillespie": {"actions"},
    "ode": {"real", "actions", "balance"},
}


def refuse_unsupported(model: Model, backend: str) -> None:
    if backend not in BACKENDS:
        raise Refused(f"unknown backend {backend}")
    wants = {
        "overdispersion": any(t.overdispersion for t in model.transitions), "deterministic": any(t.law == "deterministic" for t in model.transitions),
        "actions": bool(model.actions), "grouped": any(a.kind == "grouped" for a in model.actions), "real": bool(model.real), "balance": model.balance is not None,
        "reactive": any(a.trigger for a in model.actions),
    }
    if lost := [k for k, v in wants.items() if v and k not in BACKENDS[backend]]:
        raise Refused(f"{backend} can't run: {', '.join(lost)}")


# Inference methods and the backends they need.
METHODS = {("particle_filter", "chain_binomial"), ("if2", "chain_binomial"), ("pmmh", "chain_binomial"), ("mh", "ode"), ("nelder_mead", "ode"), ("nelder_mead", "chain_binomial")}


def method(algorithm: str, backend: str) -> tuple[str, str]:
    if (algorithm, backend) not in METHODS:
        fits = sorted(b for a, b in METHODS if a == algorithm)
        raise Refused(f"{algorithm} runs on {', '.join(fits)}, not on {backend}" if fits else f"unknown method {algorithm}")
    return algorithm, backend


def largest_remainder(total: int, weights: Sequence[float]) -> list[int]:
    """Whole shares of a total in proportion to weights; what rounding leaves goes to the largest remainders."""
    s = sum(weights)
    if s <= 0:
        return [0] * len(weights)
    exact = [total * w / s for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out
