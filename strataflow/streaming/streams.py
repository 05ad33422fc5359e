"""Structured Streaming forms: cohort counts by event time, trailing sums, sojourns and triggers with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, time: str, width: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Count and sum per window and key; rows later than the watermark are dropped by the engine."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n", "total")


def sliding_sums(stream: DataFrame, time: str, width: str, slide: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.sum(value).alias("total"), F.max(value).alias("top"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "total", "top")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *by, "n")


def sojourn_stream(events: DataFrame) -> DataFrame:
    """Stays from a stream (individual long, time double, kind int: 1 entry, -1 exit), as soon as each one ends.

    The state of an individual is one number, the time of its open entry.
    """

    def step(key, batches: Iterator, state):
        import pandas as pd

        opened = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("time", kind="stable")
        out = []
        for e in rows.itertuples():
            if e.kind == 1 and opened is None:
                opened = float(e.time)
            elif e.kind == -1 and opened is not None:
                out.append((key[0], opened, float(e.time), float(e.time) - opened))
                opened = None
        if opened is None:
            state.remove() if state.exists else None
        else:
            state.update((opened,))
        yield pd.DataFrame(out, columns=["individual", "in_time", "out_time", "dwell"])

    return events.groupBy("individual").applyInPandasWithState(step, "individual long, in_time double, out_time double, dwell double", "opened double", "append", "NoTimeout")


def trigger_stream(observations: DataFrame, width: float, threshold: float, cooldown: float = 0.0, once: bool = False, delay: float = 0.0) -> DataFrame:
    """Firings of a reactive trigger on a stream (stratum string, time double, value double).

    It fires when the sum over (time - width, time] exceeds the threshold, not within the cooldown and at most once if
    asked; the effect is due after the delay.  The state holds the values of the last window and the last firing.
    """

    def step(key, batches: Iterator, state):
        import pandas as pd

        times, values, last = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        out = []
        for e in pd.concat(list(batches)).sort_values("time", kind="stable").itertuples():
            times.append(float(e.time))
            values.append(float(e.value))
            keep = [i for i, t in enumerate(times) if t > e.time - width]
            times, values = [times[i] for i in keep], [values[i] for i in keep]
            ready = last is None or (not once and e.time - last >= cooldown)
            if ready and sum(values) > threshold:
                last = float(e.time)
                out.append((key[0], last, last + delay, sum(values)))
        state.update((times, values, last))
        yield pd.DataFrame(out, columns=["stratum", "fired_at", "due_at", "window_sum"])

    return observations.groupBy("stratum").applyInPandasWithState(step, "stratum string, fired_at double, due_at double, window_sum double", "times array<double>, vals array<double>, last double", "append", "NoTimeout")
