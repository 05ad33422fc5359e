"""Euler tours against plain recursion, on forests of several shapes."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import lineage
from strataflow.operators.tours import newick_pieces, tours

EDGES = "child long, parent long, time double, w int"


def brute(rows):
    kids, parent, w = {}, {}, {}
    for c, p, _, x in rows:
        parent[c], w[c] = p, x or 0
        if p is not None:
            kids.setdefault(p, []).append(c)
            parent.setdefault(p, None) if p not in parent else None
    for c, p, _, _ in rows:
        parent[c] = p
    out = {}
    for c in parent:
        path, up = [], c
        while up is not None:
            path.append(up)
            up = parent[up]
        below, stack = [], [c]
        while stack:
            n = stack.pop()
            below.append(n)
            stack += kids.get(n, [])
        out[c] = (path[-1], len(path) - 1, len(below), sum(w.get(n, 0) for n in below))
    return out


def shapes(seed):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else rng.randrange(i), float(i) * 0.5, rng.choice([None, 0, 1, 3])) for i in range(1, 150)]
    rows = [(c, p if p else None, t, w) for c, p, t, w in rows]
    # A parent of a hundred, a chain, a single node, and a parent without a row.
    rows += [(1000, None, 0.0, 1)] + [(1000 + i, 1000, 2.0, 1) for i in range(1, 101)]
    rows += [(2000, None, 0.0, 1)] + [(2000 + i, 1999 + i, float(i), 0) for i in range(1, 60)]
    rows += [(3000, None, 1.0, 2), (4001, 4000, 1.0, 1), (4002, 4000, 1.5, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_tours_equal_recursion(spark, seed):
    rows = shapes(seed)
    want = brute(rows)
    df = spark.createDataFrame(rows, EDGES)
    got = tours(df, {"total": F.col("w")}).collect()
    assert {r["child"]: (r["root"], r["depth"], r["size"], r["total"]) for r in got} == want
    assert {r["child"] for r in got if not r["known"]} == {4000}
    sampled = df.where("w = 3").select("child")
    heavy = brute([(c, p, t, 1 if w == 3 else 0) for c, p, t, w in rows])
    assert {r["child"] for r in lineage.pruned(df, sampled).collect()} == {c for c, v in heavy.items() if v[3]} - {4000}


def test_texts_in_pieces(spark):
    rows = [(1, None, 0.0, 0), (2, 1, 1.0, 0), (3, 1, 2.0, 0), (4, 2, 3.5, 0), (5, 2, 11.0, 0), (7, None, 4.0, 0), (8, 6, 1.0, 0)]
    toured = tours(spark.createDataFrame(rows, EDGES))
    whole = {1: "((4:2.5,5:10)2:1,3:2)1;", 7: "7;", 6: "(8)6;"}
    for piece in (1, 3, 100):
        parts = newick_pieces(toured, piece).collect()
        for root, text in whole.items():
            own = sorted((r["part"], r["text"]) for r in parts if r["root"] == root)
            assert "".join(t for _, t in own) == text and [p for p, _ in own] == list(range(len(own)))
    assert {r["root"]: r["newick"] for r in lineage.newick(spark.createDataFrame(rows, EDGES)).collect()} == whole


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").cast("double").alias("time"))
    got = tours(chain, rounds=19)
    assert got.agg(F.max("depth"), F.max("size"), F.sum("size"), F.countDistinct("root")).first()[:] == (n - 1, n, n * (n + 1) // 2, 1)


def test_cycles_are_refused_and_no_edges_give_no_rows(spark):
    loop = spark.createDataFrame([(1, 2, 0.0, 0), (2, 1, 0.0, 0)], EDGES)
    with pytest.raises(ValueError):
        tours(loop, rounds=6)
    assert tours(loop.limit(0)).count() == 0
