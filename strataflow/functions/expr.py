"""Expression trees over named values, compiled to columns.

Values are doubles; comparisons give 0.0 or 1.0.  Two rules exist for conditions: a rate is taken when its predicate is
above 0, a quantity when it is not 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import arithmetic as A


@dataclass(frozen=True)
class Expr:
    """A node: ``op`` with arguments; ``const`` and ``ref`` are leaves."""

    op: str
    args: tuple["Expr", ...] = ()
    value: object = None

    def __add__(self, o):
        return Expr("add", (self, lift(o)))

    def __radd__(self, o):
        return Expr("add", (lift(o), self))

    def __sub__(self, o):
        return Expr("sub", (self, lift(o)))

    def __rsub__(self, o):
        return Expr("sub", (lift(o), self))

    def __mul__(self, o):
        return Expr("mul", (self, lift(o)))

    def __rmul__(self, o):
        return Expr("mul", (lift(o), self))

    def __truediv__(self, o):
        return Expr("div", (self, lift(o)))

    def __rtruediv__(self, o):
        return Expr("div", (lift(o), self))

    def __pow__(self, o):
        return Expr("pow", (self, lift(o)))

    def __mod__(self, o):
        return Expr("mod", (self, lift(o)))

    def __neg__(self):
        return Expr("neg", (self,))

    def __lt__(self, o):
        return Expr("lt", (self, lift(o)))

    def __le__(self, o):
        return Expr("le", (self, lift(o)))

    def __gt__(self, o):
        return Expr("gt", (self, lift(o)))

    def __ge__(self, o):
        return Expr("ge", (self, lift(o)))

    def eq(self, o):
        return Expr("eq", (self, lift(o)))

    def ne(self, o):
        return Expr("ne", (self, lift(o)))

    def walk(self) -> Iterator["Expr"]:
        yield self
        for a in self.args:
            yield from a.walk()


def lift(x: object) -> Expr:
    return x if isinstance(x, Expr) else Expr("const", value=float(x))


def ref(name: str) -> Expr:
    """A parameter, compartment, binding or time by name."""
    return Expr("ref", value=name)


def call(op: str, *args: object) -> Expr:
    """min, max, neg, exp, log, sqrt, abs, floor, ceil, sin, cos, tanh, sum, cond, table, unchecked."""
    return Expr(op, tuple(lift(a) for a in args))


def cond(predicate: object, then: object, other: object) -> Expr:
    return call("cond", predicate, then, other)


def table(name: str, index: object) -> Expr:
    """Cell of a flat table; the index is floored and must lie inside."""
    return Expr("table", (lift(index),), name)


@dataclass
class Scope:
    """What names stand for, and which rules hold."""

    columns: Mapping[str, Column]
    tables: Mapping[str, Column] = field(default_factory=dict)
    mode: str = "strict"
    condition: str = "rate"


_COMPARE = {"lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__", "eq": "__eq__", "ne": "__ne__"}
_UNARY = {"exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tanh": F.tanh}
ARITY = {"const": 0, "ref": 0, "neg": 1, "exp": 1, "log": 1, "sqrt": 1, "abs": 1, "floor": 1, "ceil": 1, "sin": 1, "cos": 1, "tanh": 1, "unchecked": 1, "table": 1, "cond": 3, "add": 2, "sub": 2, "mul": 2, "div": 2, "pow": 2, "mod": 2, "min": 2, "max": 2} | dict.fromkeys(_COMPARE, 2)


def to_column(e: Expr, scope: Scope) -> Column:
    """Compile a tree to one column expression; Catalyst folds and shares the rest."""
    go = functools.partial(to_column, scope=scope)
    if e.op == "const":
        return F.lit(float(e.value))
    if e.op == "ref":
        return scope.columns[e.value].cast("double")
    a = [go(x) for x in e.args]
    if e.op in ("add", "sub", "mul"):
        return getattr(a[0], {"add": "__add__", "sub": "__sub__", "mul": "__mul__"}[e.op])(a[1])
    if e.op in ("div", "pow", "mod"):
        return {"div": A.divide, "pow": A.power, "mod": A.modulo}[e.op](a[0], a[1], scope.mode)
    if e.op in _COMPARE:
        return getattr(a[0], _COMPARE[e.op])(a[1]).cast("double")
    if e.op in ("min", "max"):
        return (F.least if e.op == "min" else F.greatest)(*a)
    if e.op == "neg":
        return -a[0]
    if e.op in _UNARY:
        return _UNARY[e.op](a[0])
    if e.op in ("floor", "ceil"):
        return getattr(F, e.op)(a[0]).cast("double")
    if e.op in ("sqrt", "log"):
        return {"sqrt": A.square_root, "log": A.logarithm}[e.op](a[0], scope.mode)
    if e.op == "cond":
        taken = a[0] > 0 if scope.condition == "rate" else a[0] != 0
        return F.when(taken, a[1]).otherwise(a[2])
    if e.op == "sum":
        if len(a) <= 64:
            return functools.reduce(lambda x, y: x + y, a, F.lit(0.0))
        return F.aggregate(F.array(*a), F.lit(0.0), lambda x, y: x + y)
    if e.op == "table":
        cells, i = scope.tables[e.value], F.floor(a[0])
        outside = (i < 0) | (i >= F.size(cells))
        return F.when(outside, F.raise_error(F.lit(f"index outside table {e.value}")).cast("double")).otherwise(F.get(cells, i.cast("int")))
    if e.op == "unchecked":
        return a[0]
    raise ValueError(f"unknown operator {e.op}")


def references(e: Expr) -> set[str]:
    return {x.value for x in e.walk() if x.op == "ref"}


def validate(e: Expr, names: set[str], tables: set[str] = frozenset()) -> list[str]:
    """Problems of a tree: unknown operators, names or tables, wrong arity, literals that are not finite."""
    out = []
    for x in e.walk():
        if x.op != "sum" and x.op not in ARITY:
            out.append(f"unknown operator {x.op}")
        elif x.op != "sum" and len(x.args) != ARITY[x.op]:
            out.append(f"{x.op} takes {ARITY[x.op]} arguments, not {len(x.args)}")
        if x.op == "ref" and x.value not in names:
            out.append(f"unknown name {x.value}")
        if x.op == "table" and x.value not in tables:
            out.append(f"unknown table {x.value}")
        if x.op == "const" and (x.value != x.value or abs(x.value) == float("inf")):
            out.append("a literal is not finite")
    return out


def invariants(e: Expr, parameters: set[str]) -> dict[str, Expr]:
    """Largest subtrees that only depend on parameters; they can be computed once per evaluation."""
    found: dict[str, Expr] = {}

    def visit(x: Expr) -> None:
        names = references(x)
        if x.args and names and names <= parameters:
            found.setdefault(f"inv{len(found)}", x)
            return
        for a in x.args:
            visit(a)

    visit(e)
    return found


def substitute(e: Expr, of: Mapping[Expr, str]) -> Expr:
    if e in of:
        return ref(of[e])
    return Expr(e.op, tuple(substitute(a, of) for a in e.args), e.value)


def simplify(e: Expr) -> Expr:
    """Fold constants and the identities of 0 and 1.  Division, powers and mod keep their errors and are not folded."""
    args = tuple(simplify(a) for a in e.args)
    e = Expr(e.op, args, e.value)
    c = [a.value if a.op == "const" else None for a in args]
    if e.op in ("add", "sub", "mul") and None not in c:
        return lift({"add": c[0] + c[1], "sub": c[0] - c[1], "mul": c[0] * c[1]}[e.op]) if len(c) == 2 else e
    if e.op == "neg" and c[0] is not None:
        return lift(-c[0])
    if e.op == "add" and 0.0 in c:
        return args[1 - c.index(0.0)]
    if e.op == "sub" and c[1] == 0.0:
        return args[0]
    if e.op == "mul" and 1.0 in c:
        return args[1 - c.index(1.0)]
    if e.op == "mul" and 0.0 in c:
        return lift(0)
    if e.op == "sum":
        rest = tuple(a for a in args if a != lift(0))
        return rest[0] if len(rest) == 1 else Expr("sum", rest) if rest else lift(0)
    return e


def differentiate(e: Expr, name: str) -> Expr:
    """Derivative by one name.  Piecewise-constant nodes have derivative 0; ``abs``, ``min`` and ``max`` switch sides."""
    d = functools.partial(differentiate, name=name)
    if e.op == "ref":
        return lift(1 if e.value == name else 0)
    if e.op in ("const", "floor", "ceil", "mod", "table", *_COMPARE):
        if e.op in ("mod", "table") and any(name in references(a) for a in e.args):
            raise ValueError(f"{e.op} has no derivative by {name}")
        return lift(0)
    a = e.args
    if e.op in ("add", "sub"):
        return simplify(Expr(e.op, (d(a[0]), d(a[1]))))
    if e.op == "sum":
        return simplify(Expr("sum", tuple(d(x) for x in a)))
    if e.op == "mul":
        return simplify(d(a[0]) * a[1] + a[0] * d(a[1]))
    if e.op == "div":
        return simplify((d(a[0]) * a[1] - a[0] * d(a[1])) / (a[1] * a[1]))
    if e.op == "pow":
        if a[1].op == "const":
            return simplify(a[1] * a[0] ** (a[1].value - 1) * d(a[0]))
        return simplify(e * (d(a[1]) * call("log", a[0]) + a[1] * d(a[0]) / a[0]))
    if e.op == "cond":
        return simplify(Expr("cond", (a[0], d(a[1]), d(a[2]))))
    if e.op in ("min", "max"):
        test = a[0] <= a[1] if e.op == "min" else a[0] >= a[1]
        return simplify(cond(test, d(a[0]), d(a[1])))
    chain = {
        "neg": lambda x: lift(-1), "exp": lambda x: e, "log": lambda x: 1 / x, "sqrt": lambda x: 0.5 / e, "sin": lambda x: call("cos", x),
        "cos": lambda x: -call("sin", x), "tanh": lambda x: 1 - e * e, "abs": lambda x: cond(x >= 0, 1, -1), "unchecked": lambda x: lift(1),
    }
    return simplify(chain[e.op](a[0]) * d(a[0]))


@dataclass(frozen=True)
class Dim:
    """Physical dimension: exponents of population and time."""

    population: float = 0
    time: float = 0


def dimension(e: Expr, known: Mapping[str, Dim]) -> Dim | None:
    """Dimension of a tree, or None for a bare literal that fits anything; raises where sums or functions mix them."""
    d = [dimension(a, known) for a in e.args]
    if e.op == "const":
        return None
    if e.op == "ref":
        return known[e.value]
    if e.op == "unchecked":
        return None
    if e.op in ("add", "sub", "min", "max", "sum", *_COMPARE):
        kinds = {x for x in d if x is not None}
        if len(kinds) > 1:
            raise ValueError(f"{e.op} mixes dimensions {sorted(kinds, key=str)}")
        return Dim() if e.op in _COMPARE else next(iter(kinds), None)
    if e.op in ("mul", "div"):
        sign = 1 if e.op == "mul" else -1
        a, b = (x or Dim() for x in d)
        return Dim(a.population + sign * b.population, a.time + sign * b.time)
    if e.op == "pow":
        a = d[0] or Dim()
        if e.args[1].op != "const":
            if a != Dim():
                raise ValueError("a power with a variable exponent needs a base without dimension")
            return Dim()
        return Dim(a.population * e.args[1].value, a.time * e.args[1].value)
    if e.op == "sqrt":
        a = d[0] or Dim()
        return Dim(a.population / 2, a.time / 2)
    if e.op == "cond":
        kinds = {x for x in d[1:] if x is not None}
        if len(kinds) > 1:
            raise ValueError("branches have different dimensions")
        return next(iter(kinds), None)
    if e.op in ("exp", "log", "sin", "cos", "tanh") and d[0] not in (None, Dim()):
        raise ValueError(f"{e.op} needs an argument without dimension")
    return Dim() if e.op in ("exp", "log", "sin", "cos", "tanh", "table") else d[0]


def over_compartments(compartments: list[str] | tuple[str, ...], body) -> Expr:
    """The sum of ``body(ref)`` over all whole-number compartments of a model."""
    return call("sum", *[body(ref(c)) for c in compartments])


def indexed(name: str, dims: tuple[str, ...], **levels: str) -> Expr:
    """A stratified value by the names of its dimensions, in any order; all of them must be given."""
    if lost := [d for d in dims if d not in levels]:
        raise ValueError(f"{name} needs {', '.join(lost)} too")
    if more := sorted(set(levels) - set(dims)):
        raise ValueError(f"{name} has no dimension {', '.join(more)}")
    return ref("_".join([name, *[levels[d] for d in dims]]))


def on_grid(points: DataFrame, bindings: Mapping[str, Expr], start: float, stop: float, step: float) -> DataFrame:
    """Named expressions of parameters and time on a time grid: every row of ``points`` at every time, one column per name."""
    n = int((stop - start) / step + 1e-9)
    rows = points.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: start + i * step)))
    columns = {c: F.col(c) for c in rows.columns}
    for name, e in bindings.items():
        rows = rows.withColumn(name, to_column(e, Scope(columns)))
        columns[name] = F.col(name)
    return rows
