"""Effective sample sizes of long chains against arrays of whole chains."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.operators import chains, diagnostics


def halves(x):
    h = x.shape[1] // 2
    return np.concatenate((x[:, :h], x[:, x.shape[1] - h :]))


def size(x):
    m, n = x.shape
    if n < 3 or np.ptp(x) == 0:
        return math.nan
    d = x - x.mean(axis=1, keepdims=True)
    cov = np.array([(d[:, : n - k] * d[:, k:]).sum() / m / n for k in range(n)])
    rho = 1 - (cov[0] * n / (n - 1) - cov) / (cov[0] + x.mean(axis=1).var(ddof=1))
    rho[0] = 1
    pairs, t = [rho[0] + rho[1]], 0
    while t < n - 5 and pairs[-1] > 0:
        t += 2
        pairs.append(rho[t] + rho[t + 1])
    tau = -1 + 2 * np.minimum.accumulate(pairs[:-1]).sum() + max(rho[t], 0) if t else 2.0
    return m * n / max(tau, 1 / math.log10(m * n))


def whole(groups):
    out = {}
    for k, x in groups.items():
        if len({len(c) for c in x}) > 1 or not np.isfinite(np.array(x, float)).all() or np.ptp(x := np.array(x, float)) == 0 or x.shape[1] < 4:
            out[k] = (math.nan, math.nan)
            continue
        split = halves(x)
        ranks = pd.Series(split.ravel()).rank()
        z = np.array([NormalDist().inv_cdf((r - 0.375) / (len(ranks) + 0.25)) for r in ranks]).reshape(split.shape)
        tails = [size(halves((x <= np.quantile(x, p)).astype(float))) for p in (0.05, 0.95)]
        out[k] = (size(z), math.nan if any(map(math.isnan, tails)) else min(tails))
    return out


def walk(rng, n, keep):
    v, out = 0.0, []
    for _ in range(n):
        v = keep * v + rng.gauss(0, 1)
        out.append(v)
    return out


def made():
    rng = random.Random(4)
    return {
        "slow": [walk(rng, 301, 0.98) for _ in range(3)], None: [walk(rng, 120, 0.5) for _ in range(2)], "ties": [[rng.randrange(5) * 1.0 for _ in range(77)] for _ in range(4)],
        "apart": [[100.0 * c + rng.random() for _ in range(90)] for c in range(3)], "rise": [[i + 0.0 for i in range(250)]], "turns": [[(-1.0) ** i * (1 + i) for i in range(64)] for _ in range(2)],
        "six": [[3.0, 1.0, 2.0, 6.0, 5.0, 4.0]], "five": [[3.0, 1.0, 2.0, 5.0, 4.0]], "flat": [[2.0] * 20] * 2, "middle": [[0.0] * 5 + [1.0] + [0.0] * 5], "uneven": [[1.0, 2.0, 3.0] * 5, [1.0, 2.0] * 6],
        "null": [[1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]], "infinite": [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, math.inf]],
    }


def frame(spark, groups):
    rows = [(k, c, i, v) for k, x in groups.items() for c, chain in enumerate(x) for i, v in enumerate(chain)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, chain int, i int, v double").repartition(3)


@pytest.mark.parametrize(("block", "halo", "looked_up", "sent"), [(1024, 64, 2_000_000, 20_000), (8, 4, 2_000_000, 0), (6, 4, 0, 20_000)])
def test_sizes_equal_those_of_whole_arrays(spark, monkeypatch, block, halo, looked_up, sent):
    """Also where chains lie over many blocks, positive lags go far beyond one, and scores are joined instead of looked up."""
    for name, v in {"BLOCK": block, "HALO": halo, "LONGEST": 2 * block if block < 1000 else chains.LONGEST, "GROWTH": 2 if block < 1000 else chains.GROWTH, "LOOKED_UP": looked_up, "SENT": sent}.items():
        monkeypatch.setattr(chains, name, v)
    groups = made()
    got = {r["k"]: (r["ess_bulk"], r["ess_tail"]) for r in diagnostics.chain_ess(frame(spark, groups), ["k"], "chain", "i", "v").collect()}
    want = whole(groups)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, nan_ok=True), k
    assert sum(not math.isnan(b) for b, _ in want.values()) >= 7


def test_chains_are_cut_to_the_shortest(spark):
    groups = {k: v for k, v in made().items() if k in ("uneven", "ties", "five")}
    groups["ties"][1] = groups["ties"][1][:40]
    got = {r["k"]: (r["ess_bulk"], r["ess_tail"]) for r in diagnostics.chain_ess(frame(spark, groups), ["k"], "chain", "i", "v", common=True).collect()}
    want = whole({k: [c[: min(map(len, x))] for c in x] for k, x in groups.items()})
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, nan_ok=True), k
    assert diagnostics.chain_ess(frame(spark, groups).limit(0), ["k"], "chain", "i", "v").count() == 0


def test_pieces_are_short_and_follow_each_other(spark):
    """One chain over all tasks: every draw once, in order, in arrays of bounded length."""
    df = spark.range(30_000).select(F.lit("k").alias("k"), F.lit(0).alias("chain"), "id", (F.col("id") * 1.0).alias("v"))
    rows = chains.pieces(df, ["k"], "chain", "id", "v").collect()
    assert max(len(r["_v"]) for r in rows) <= chains.BLOCK
    assert [x for r in sorted(rows, key=lambda r: r["_from"]) for x in r["_v"]] == list(map(float, range(30_000)))
    assert all(r["_v"][0] == r["_from"] for r in rows)
