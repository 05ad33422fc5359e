"""Replays of event logs against a plain loop, as streams of batches."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from strataflow.operators import lineage
from strataflow.queries import REGISTRY

SCHEMA = "run long, step long, time double, kind string, deme long, to_deme long, weights map<long,double>"
OUT = ["run", "step", "time", "kind", "individual", "parent", "deme", "parent_deme", "logprob"]


def log(seed, runs=3, n=700):
    """Events in which pools run dry and masses come, go and are 0."""
    rng, rows = random.Random(seed), []
    for run in range(runs):
        size = dict.fromkeys(range(4), 0)
        for step in range(n):
            full, u = [d for d, k in size.items() if k], rng.random()
            deme, to = rng.choice(full or [0]), rng.randrange(4)
            if u < 0.4 or not full:
                weights = rng.choice([None, {}, {0: 1.0, 1: 2.0, 3: 0.1}, {to: 0.0, 2: 0.5}])
                rows.append((run, step, step / 2, "birth", to, None, weights))
                size[to] += 1
                continue
            size[deme] -= 1
            size[to] += u < 0.7
            rows.append((run, step, step / 2, "move" if u < 0.7 else "end", deme, to if u < 0.7 else None, None))
    return rows


def replayed(rows, seed):
    out, pools, rng, fresh, now = {}, {}, None, 0, None
    for run, step, _, kind, deme, to, weights in sorted(rows, key=lambda r: r[:2]):
        if run != now:
            pools, rng, fresh, now = {}, np.random.default_rng([seed, run]), 0, run
        pool = pools.setdefault(deme, [])
        if kind == "birth":
            masses = {k: v for k, v in (weights or {}).items() if v > 0 and pools.get(k)}
            parent, source, p = None, None, 1.0
            if masses:
                names, u = sorted(masses), rng.random() * sum(masses.values())
                source = names[min(int(np.searchsorted(np.cumsum([masses[k] for k in names]), u, side="right")), len(names) - 1)]
                parent = pools[source][rng.integers(len(pools[source]))]
                p = masses[source] / sum(masses.values()) / len(pools[source])
            pool.append(fresh)
            out[run, step] = (fresh, parent, deme, source, math.log(p))
            fresh += 1
            continue
        i, n = int(rng.integers(len(pool))), len(pool)
        pool[i], pool[-1] = pool[-1], pool[i]
        who = pool.pop()
        if kind == "move":
            pools.setdefault(to, []).append(who)
        out[run, step] = (who, None, to if kind == "move" else deme, None, -math.log(n))
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_replays_equal_a_loop(spark, batch):
    """Also where somebody moves into the deme they are in: the choice was among all who were there."""
    rows = log(batch)
    assert any(r[3] == "move" and r[4] == r[5] for r in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = lineage.realize(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA), "run", 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = replayed(rows, 5)
    assert len(got) == len(rows)
    for r in got:
        *who, logp = want[r["run"], r["step"]]
        assert [r["individual"], r["parent"], r["deme"], r["parent_deme"]] == who and r["logprob"] == pytest.approx(logp, abs=1e-12), r


def test_a_run_is_not_held_in_memory():
    """A batch's lines are out before the next one is read."""
    rows, read = [r for r in log(2, 1, 300)], []
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.float64())]

    def batches():
        for k in range(0, 300, 10):
            read.append(k)
            columns = list(zip(*rows[k : k + 10], strict=True))
            columns[6] = [list(w.items()) if w is not None else None for w in columns[6]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*OUT[:4], "deme", "to_deme", "weights"])

    for i, out in enumerate(lineage._replay(OUT, 5)(batches())):
        assert out.num_rows == 10 and len(read) == i + 1


def test_actions_without_members_are_refused(spark):
    for kind, deme, to in (("end", 0, None), ("move", 1, 0), ("birth", None, None)):
        with pytest.raises(Exception, match="no member|no deme"):
            lineage.realize(spark.createDataFrame([(0, 0, 0.0, kind, deme, to, None)], SCHEMA)).collect()


def test_the_structure_is_read_off_one_replay_without_windows(spark):
    plan = REGISTRY["realized_structure"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(w in plan for w in ("Window", "Join", "InPandas"))
