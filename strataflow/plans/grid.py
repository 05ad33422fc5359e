"""Planning of run grids, scenarios, schedules and effect timelines."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import Refused, refuse_any
from strataflow.operators.order import numbered_within


def axis(spec: Sequence[float] | str) -> list[float]:
    """A list, ``lin(a,b,n)`` or ``log10(a,b,n)``; both ends are included."""
    if not isinstance(spec, str):
        return [float(x) for x in spec]
    kind, rest = spec.rstrip(")").split("(")
    a, b, n = rest.split(",")
    a, b, n = float(a), float(b), int(n)
    if n < 1 or kind not in ("lin", "log10") or (kind == "log10" and min(a, b) <= 0):
        raise Refused(f"bad axis {spec}")
    steps = [i / (n - 1) if n > 1 else 0.0 for i in range(n)]
    if kind == "lin":
        return [a + (b - a) * s for s in steps]
    return [10 ** (math.log10(a) + (math.log10(b) - math.log10(a)) * s) for s in steps]


def sweep(spark: SparkSession, axes: Mapping[str, Sequence[float] | str]) -> DataFrame:
    """(point_id, one column per parameter): the product of the axes in order of name, the first varying slowest."""
    names = sorted(axes)
    values = [axis(axes[n]) for n in names]
    if math.prod(map(len, values)) > 1_000_000:
        frames = [spark.createDataFrame(list(enumerate(v)), f"_i{k} long, `{n}` double") for k, (n, v) in enumerate(zip(names, values, strict=True))]
        out = frames[0]
        for f in frames[1:]:
            out = out.crossJoin(f)
        number = F.lit(0).cast("long")
        for k, v in enumerate(values):
            number = number * len(v) + F.col(f"_i{k}")
        return out.select(number.alias("point_id"), *names)
    rows = [(i, *p) for i, p in enumerate(itertools.product(*values))]
    return spark.createDataFrame(rows, "point_id long, " + ", ".join(f"`{n}` double" for n in names))


def seeds(spec: str | Sequence[int]) -> list[int]:
    """``a:b`` with both ends, or a list."""
    if isinstance(spec, str):
        if ":" in spec:
            a, b = map(int, spec.split(":"))
            if b < a:
                raise Refused(f"bad seed range {spec}")
            return list(range(a, b + 1))
        return [int(x) for x in spec.split(",")]
    return list(map(int, spec))


def run_grid(scenarios: DataFrame, points: DataFrame, replicates: int, base_seed: int, draws: bool = False) -> DataFrame:
    """(scenario, point columns, replicate, seed, cell).

    The seed never depends on the scenario, so arms share random numbers; it depends on the point for posterior draws
    only, so a design sweep compares points under the same numbers.
    """
    reps = points.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    grid = scenarios.select("scenario").crossJoin(points).crossJoin(reps)
    source = [F.lit(base_seed), F.col("replicate"), *([F.col("point_id")] if draws else [])]
    return grid.withColumn("seed", F.pmod(F.xxhash64(*source), F.lit(2**53))).withColumn("cell", F.xxhash64("scenario", "point_id", "replicate"))


def in_order(grid: DataFrame) -> DataFrame:
    """Canonical order: scenario, point, replicate."""
    return grid.orderBy("scenario", "point_id", "replicate")


def scenario_parameters(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(scenario, name, value) from base (name, value) and changes (scenario, name, set_value, scale)."""
    names = changes.select("scenario").distinct().crossJoin(base)
    joined = names.join(changes, ["scenario", "name"], "left")
    return joined.select("scenario", "name", F.coalesce("set_value", F.col("value") * F.coalesce("scale", F.lit(1.0))).alias("value"))


def compose(presets: Mapping[str, Mapping], name: str, seen: tuple[str, ...] = ()) -> dict:
    """A scenario with what it extends: later changes win, enabled and disabled sets are merged."""
    if name in seen:
        raise Refused(f"scenarios extend each other: {' > '.join((*seen, name))}")
    own = presets[name]
    out: dict = {"set": {}, "scale": {}, "enable": set(), "disable": set()}
    for parent in own.get("extends", ()):
        up = compose(presets, parent, (*seen, name))
        out["set"] |= up["set"]
        out["scale"] |= up["scale"]
        out["enable"] |= up["enable"]
        out["disable"] |= up["disable"]
    out["set"] |= own.get("set", {})
    out["scale"] |= own.get("scale", {})
    out["enable"] = (out["enable"] | set(own.get("enable", ()))) - set(own.get("disable", ()))
    out["disable"] = (out["disable"] | set(own.get("disable", ()))) - set(own.get("enable", ()))
    if clash := set(out["set"]) & set(out["scale"]):
        raise Refused(f"{name} both sets and scales {sorted(clash)}")
    return out


def collisions(changes: DataFrame, coordinates: list[str]) -> DataFrame:
    """Scenario changes of parameters that the sweep also moves."""
    return changes.where(F.col("name").isin(*coordinates))


def refuse_collisions(changes: DataFrame, coordinates: list[str]) -> None:
    refuse_any(collisions(changes, coordinates), "a scenario changes a swept parameter")


def fire_times(start: Column, stop: Column, at: Sequence[float] | None = None, every: float | None = None, at_day: float = 0.0, period: float | None = None) -> Column:
    """Array of effect times in [start, stop]: given times, or recurring ones from ``start`` (or at a day of each period)."""
    if at is not None:
        return F.filter(F.array(*[F.lit(float(t)) for t in sorted(at)]), lambda t: (t >= start) & (t <= stop))
    step = float(period or every)
    first = start if period is None else F.ceil((start - at_day) / step) * step + at_day
    n = F.floor((stop - first) / step).cast("int")
    return F.when(n < 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: first + i * step))


def n_substeps(start: float, stop: float, dt: float) -> int:
    return max(0, math.ceil((stop - start) / dt - 1e-9))


#: Share of a step within which two times count as one.
TOLERANCE = 1e-9


def step_end(k: int, start: float, stop: float, dt: float) -> float:
    """Where step k ends; the last one is shortened to end with the run."""
    return stop if 0 < k == n_substeps(start, stop, dt) else start + k * dt


def step_length(k: int, start: float, stop: float, dt: float) -> float:
    """Length of step k, counted from 0: ``dt``, but for a last step that is cut short."""
    n = n_substeps(start, stop, dt)
    cut = stop - step_end(n - 1, start, stop, dt)
    return cut if k == n - 1 and cut < (1 - TOLERANCE) * dt else dt


def effect_step(t: float, start: float, stop: float, dt: float) -> int | None:
    """The step at whose end an effect happens: the nearer end, of two as near the later one; None outside the run."""
    if not start - TOLERANCE * dt <= t <= stop + TOLERANCE * dt:
        return None
    n = n_substeps(start, stop, dt)
    before = min(max(math.floor((t - start) / dt), 0), n)
    after = min(before + 1, n)
    late = step_end(after, start, stop, dt) - t <= t - step_end(before, start, stop, dt) + 2 * TOLERANCE * dt
    return after if late else before


def snap(effects: DataFrame, time: str, start: float, dt: float, stop: float | None = None) -> DataFrame:
    """Adds ``step``, the grid step at whose end an effect happens, and its number in that step's batch.

    The nearest end counts, of two as near the later one.  With ``stop``, effects outside the run go, and one inside a
    shortened last step takes the nearer of that step's own ends.
    """
    at = (F.col(time) - start) / dt
    step = F.floor(at + 0.5 + TOLERANCE).cast("long")
    rows = effects
    if stop is not None:
        n, span = n_substeps(start, stop, dt), (stop - start) / dt
        rows = rows.where((at >= -TOLERANCE) & (at <= span + TOLERANCE))
        inside = (at > n - 1) & F.lit(span < n - TOLERANCE)
        step = F.when(inside, F.when(span - at <= at - (n - 1) + TOLERANCE, n).otherwise(n - 1)).otherwise(F.least(step, F.lit(n))).cast("long")
    rows = rows.withColumn("step", step)
    return rows.withColumn("in_batch", F.row_number().over(W.partitionBy("step").orderBy(time, *[c for c in effects.columns if c != time])))


def timeline(stops: DataFrame) -> DataFrame:
    """Order of stops (time, reason): at one time effects come before outputs, then observations, then the end."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("effect", 0), ("output", 1), ("observation", 2), ("end", 3)) for x in kv]), F.col("reason"))
    return stops.withColumn("rank", rank).orderBy("time", "rank")


def output_times(start: float, stop: float, every: float | None = None, at: Sequence[float] | None = None) -> list[float]:
    if at is not None:
        return sorted({float(t) for t in at if start <= t <= stop})
    n = math.floor((stop - start) / every + 1e-9)
    return [start + i * every for i in range(n + 1)]


def refuse_past_end(rows: DataFrame, time: str, end: float) -> None:
    refuse_any(rows.where(F.col(time) > end), "data lie past the end of the run")


def latin_hypercube(spark: SparkSession, bounds: Mapping[str, tuple[float, float]], n: int, seed: int, log: Sequence[str] = ()) -> DataFrame:
    """n points, one in each of n equal strata of every parameter; strata are shuffled by a hash per parameter."""
    rows = spark.range(n).select(F.col("id").alias("point_id"))
    for k, (name, (lo, hi)) in enumerate(sorted(bounds.items())):
        h = F.xxhash64(F.lit(seed), F.lit(k), F.col("point_id"))
        rows = numbered_within(rows.withColumn("_h", h), [], "_h", "_i", "_all").drop("_h", "_all")
        stratum = F.col("_i") - 1
        jitter = F.pmod(F.xxhash64(F.lit(seed), F.lit(k + 1000), F.col("point_id")), F.lit(2**31)) / 2.0**31
        u = (stratum + jitter) / n
        rows = rows.withColumn(name, lo * F.pow(F.lit(hi / lo), u) if name in log else lo + (hi - lo) * u).drop("_i")
    return rows
