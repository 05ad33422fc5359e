"""Segmented scans against plain loops, with groups that span many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators.scan import scanned


def brute(rows, key, order, column):
    """(last, before, sum) of every row."""
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[key] is not None, r[key] or "", r[order])):
        last, total = state.get(r[key], (None, 0))
        v = r[column]
        now = (v if v is not None else last, total + (v or 0))
        out[r["id"]] = (now[0], last, now[1])
        state[r[key]] = now
    return out


@pytest.mark.parametrize(("seed", "share", "batch"), [(0, 0.0, 10_000), (1, 0.9, 7), (2, 1.0, 50), (3, 0.5, 3)])
def test_scans_equal_loops(spark, seed, share, batch):
    rng = random.Random(seed)
    rows = [{"id": i, "k": "hot" if rng.random() < share else rng.choice([None, "a", "b", "c", "d"]), "t": rng.random(), "v": rng.choice([None, None, 1, 2, 5])} for i in range(600)]
    df = spark.createDataFrame([(r["id"], r["k"], r["t"], r["v"], float(r["v"]) / 4 if r["v"] else None) for r in rows], "id int, k string, t double, v int, x double")
    df = df.withColumn("s", F.when(F.col("v").isNotNull(), F.struct("v", F.lit(None).cast("string").alias("n"))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for direction, want in ((F.col("t").asc(), brute(rows, "k", "t", "v")), (F.col("t").desc(), brute([r | {"t": -r["t"]} for r in rows], "k", "t", "v"))):
            got = scanned(df, ["k"], [direction], {"last": ("last", "v"), "prev": ("before", "s"), "total": ("sum", "v"), "part": ("sum", "x")}).collect()
            assert len(got) == len(rows)
            for r in got:
                last, before, total = want[r["id"]]
                assert (r["last"], r["prev"] and r["prev"]["v"], r["total"]) == (last, before, total), r
                assert r["part"] == pytest.approx(total / 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_do_not_pile_up_in_one_task(spark):
    """All rows in one group at one time: sums rise by one, and tasks share the rows."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("one"))
    got = scanned(df, ["k"], [F.col("t").asc()], {"n": ("sum", "one")})
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[2]
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 40_000, 40_000)


def test_scans_without_groups_or_rows(spark):
    df = spark.createDataFrame([(3, 1.5), (1, 0.5), (2, None)], "t int, v double")
    got = {r["t"]: r["s"] for r in scanned(df, [], [F.col("t").asc()], {"s": ("sum", "v")}).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 2.0}
    assert scanned(df.limit(0), [], [F.col("t").asc()], {"s": ("sum", "v")}).count() == 0
    with pytest.raises(ValueError):
        scanned(df, [], [F.col("t").asc()], {"s": ("max", "v")})
    with pytest.raises(ValueError):
        scanned(df.withColumn("x", F.lit("a")), [], [F.col("t").asc()], {"s": ("sum", "x")})
