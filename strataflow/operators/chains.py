"""Effective sample sizes of chains of any length.

Draws are sorted by range of (group, chain, draw) once and written as pieces of a chain, so numbering takes one row per task.  Normal
scores belong to distinct values: where these are few, tasks look them up in a table in the shared folder, else they are joined.
Scores are regrouped into blocks of a half chain that also hold the first scores of the next block, so a block gives its sums of lag
products by itself.  The sequence rule looks at more lags only where all pairs of lags so far are positive: blocks then get longer, and
from :data:`LONGEST` on are paired with blocks farther on.  No task holds more than a few blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from strataflow.functions.arithmetic import finite
from strataflow.operators.order import interpolated, joined_by, ordered_counts
from strataflow.operators.scratch import cut

#: Draws of a piece and of a block, scores of the next block that it also holds, growth of blocks and their longest.
BLOCK = 1024
HALO = 64
GROWTH = 8
LONGEST = BLOCK * GROWTH**3
#: Distinct values up to which tasks look scores up, and rows up to which a table by group is sent to all tasks.
LOOKED_UP = 1_000_000
SENT = 20_000
#: Shares of draws that the tail's size is about.
TAILS = (0.05, 0.95)
#: Of a chain's half.
HALF = ["_g", "_chain", "_half"]


def _small(df: DataFrame) -> DataFrame:
    """To be sent to all tasks, if it is small."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def _pieces(keys: list[str], names: list[str]):
    """Cuts a task's sorted rows into pieces of one chain each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, key, at, seq = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (batch.column(c).to_numpy() for c in ("_g1", "_g2"))
            fresh = np.ones(n, bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            fresh[0] = key is not None and key != (a[0], b[0])
            key, place = (a[-1], b[-1]), np.arange(n)
            begun = np.maximum.accumulate(np.where(fresh, place, -1))
            ats = np.where(begun >= 0, place - begun, at + place)
            starts = np.flatnonzero(fresh | (ats % BLOCK == 0) | (place == 0))
            seqs = seq + np.cumsum(fresh)
            values = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), batch.column("_v"))
            found = [batch.column(c).take(pa.array(starts)) for c in [*keys, "_g1", "_g2"]]
            own = [pa.array(np.full(len(starts), task, np.int32)), pa.array(seqs[starts].astype(np.int64)), pa.array(ats[starts].astype(np.int64)), values]
            at, seq = int(ats[-1]) + 1, int(seqs[-1])
            yield pa.RecordBatch.from_arrays([*found, *own], names=names)

    return run


def pieces(df: DataFrame, by: Sequence[str], chain: str, order: str, value: str) -> DataFrame:
    """(by, _chain, _from, _v): the chains' values in order, an array of at most :data:`BLOCK`, and how many of the chain are before it."""
    spark = df.sparkSession
    keys = [*by, "_chain"]
    rows = df.select(*by, F.col(chain).alias("_chain"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    sort = [F.col(c).asc_nulls_first() for c in [*keys, "_o", "_v"]]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort)
    parts = [c for name in keys for c in (F.col(name), F.col(name).isNull())]
    rows = rows.select(*keys, "_v", F.xxhash64(*parts).alias("_g1"), F.hash(*parts).alias("_g2"))
    schema = StructType([*[StructField(c, rows.schema[c].dataType) for c in keys], StructField("_g1", LongType()), StructField("_g2", IntegerType())])
    schema = schema.add("_task", IntegerType()).add("_seq", LongType()).add("_at", LongType()).add("_v", ArrayType(DoubleType()))
    table = cut(rows.mapInArrow(_pieces(keys, schema.names), schema))
    place, key = F.struct("_seq", "_at"), F.struct("_g1", "_g2")
    ends = table.groupBy("_task").agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"), F.max("_seq").alias("seq"), F.max_by(F.col("_at") + F.size("_v"), place).alias("upto")).collect()  # a row per task
    carried, open_key, length = [], None, 0
    for r in sorted(ends, key=lambda r: r["_task"]):
        before = length if r["first"] == open_key else 0
        carried.append((r["_task"], before))
        length, open_key = r["upto"] + (before if r["seq"] == 0 else 0), r["last"]
    carried = spark.createDataFrame(carried, "_task int, _before long")  # a row per task
    return table.join(F.broadcast(carried), "_task").select(*keys, (F.col("_at") + F.when(F.col("_seq") == 0, F.col("_before")).otherwise(0)).alias("_from"), "_v")


def _scores(batches):
    """Normal scores of ranks."""
    from statistics import NormalDist

    import pyarrow as pa

    score = NormalDist().inv_cdf
    for batch in batches:
        p = batch.column("_p").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if x is None else score(x) for x in p], pa.float64())], names=[*batch.schema.names[:-1], "_z"])


def _blocks(files: list[str]):
    """(_g, _chain, _half, _b, _off, _z): pieces as scores, cut at the borders of halves and blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        tables = []
        for f in files:
            system, path = fs.FileSystem.from_uri("s3" + f.removeprefix("s3a") if f.startswith("s3a://") else f)
            tables.append(pq.read_table(path, filesystem=system, columns=["_g", "_v", "_z"], partitioning=None))
        g, v, z = (pa.concat_tables(tables).column(c).to_numpy() for c in ("_g", "_v", "_z"))
        o = np.lexsort((v, g))
        g, v, z = g[o], v[o], z[o]
        del tables, o
        # Some megabytes of scores at a time.
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            groups, lengths, begins = (batch.column(c).to_numpy() for c in ("_g", "_n", "_from"))
            which, where, found = [], [], []
            for row, (values, n, begin) in enumerate(zip(batch.column("_v"), lengths.tolist(), begins.tolist(), strict=True)):
                x = values.values.to_numpy()
                lo, hi = np.searchsorted(g, groups[row]), np.searchsorted(g, groups[row], "right")
                scores = z[lo + np.searchsorted(v[lo:hi], x)]
                for half, start in ((0, 0), (1, n - n // 2)):
                    a, end = max(begin, start), min(begin + len(x), start + n // 2)
                    while a < end:
                        b, off = divmod(a - start, BLOCK)
                        stop = min(end, start + (b + 1) * BLOCK)
                        part = scores[a - begin : stop - begin]
                        which.append(row)
                        where.append((half, b, off))
                        found.append(part)
                        if b and off < HALO:
                            which.append(row)
                            where.append((half, b - 1, BLOCK + off))
                            found.append(part[: HALO - off])
                        a = stop
            if not found:
                continue
            half, b, off = (pa.array(c, t) for c, t in zip(zip(*where, strict=True), (pa.int32(), pa.int64(), pa.int32()), strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column("_g").take(take), batch.column("_chain").take(take), half, b, off, lists], names=[*HALF, "_b", "_off", "_z"])

    return run


def _series(z, low, high):
    """The three series of a block: scores, and whether a draw is in the lower tail and below the upper one."""
    return z, (z <= low).astype(float), (z <= high).astype(float)


def _totals():
    """Sums of the three series over each block's own scores."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(batch.column("_z"), *(batch.column(c).to_pylist() for c in ("_b", "_n", "_low", "_high")), strict=True)
            sums = [[float(s.sum()) for s in _series(z.values.to_numpy()[: min(BLOCK, n // 2 - b * BLOCK)], low, high)] for z, b, n, low, high in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in HALF], *[pa.array([s[k] for s in sums], pa.float64()) for k in range(3)]], names=[*HALF, "_s0", "_s1", "_s2"])

    return run


def _products(lags: int):
    """(_g, _k, _sums): sums of own(i) other(i + lag) for lags from 0, added up over a batch's blocks of a group."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def of(own, other):
            if lags <= HALO:
                return np.array([own[: len(other) - k] @ other[k : k + len(own)] if k < len(other) else 0.0 for k in range(lags)])
            size = 1 << (len(own) + len(other) - 1).bit_length()
            out = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(other, size), size)[:lags]
            return np.where(np.arange(lags) < len(other), np.pad(out, (0, lags - len(out))), 0.0)

        for batch in batches:
            added: dict = {}
            rows = zip(batch.column("_own"), batch.column("_other"), *(batch.column(c).to_pylist() for c in ("_g", "_low", "_high", "_m0", "_m1", "_m2")), strict=True)
            for own, other, g, low, high, *means in rows:
                x, y = (_series(s.values.to_numpy(), low, high) for s in (own, other))
                for k in range(3):
                    added[g, k] = added.get((g, k), 0.0) + of(x[k] - means[k], y[k] - means[k])
                    if len(added) * lags > 1_000_000:
                        yield out(added, pa, np)
                        added = {}
            if added:
                yield out(added, pa, np)

    def out(added, pa, np):
        g, k = zip(*added, strict=True)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * lags, pa.int32()), pa.array(np.concatenate(list(added.values()))))
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int32()), sums], names=["_g", "_k", "_sums"])

    return run


STATE = "_g long, _k int, n long, m long, between double, cov double, t long, pair double, low double, head double, even double, open boolean, ess double"


def _sequence(lo: int, lags: int):
    """Goes on with Geyer's initial positive and monotone sequences from what the lags before have left, over lags from ``lo`` on."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                sums, n, m = r.pop("_sums"), r["n"], r["m"]
                if r["open"]:
                    if lo == 0:
                        r["cov"] = sums[0] / m / n
                    within, total = r["cov"] * n / (n - 1), r["cov"] + r["between"]
                    rho = lambda k: 1 - (within - sums[k - lo] / m / n) / total  # noqa: B023, E731
                    if r["t"] < 0:
                        r |= {"t": 0, "pair": 1 + rho(1), "even": 1.0, "low": math.inf, "head": 0.0}
                    while r["t"] < n - 5 and r["pair"] > 0 and r["t"] + 3 < lo + lags:
                        r["low"] = min(r["low"], r["pair"])
                        r["head"] += r["low"]
                        r["t"] += 2
                        r["even"] = rho(r["t"])
                        r["pair"] = r["even"] + rho(r["t"] + 1)
                    r["open"] = r["t"] < n - 5 and r["pair"] > 0
                    if not r["open"]:
                        tau = -1 + 2 * r["head"] + max(r["even"], 0.0) if r["t"] else 2.0
                        r["ess"] = m * n / max(tau, 1 / math.log10(m * n))
                out.append(r)
            import pandas as pd

            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def _longer(blocks: DataFrame, size: int, far: int) -> DataFrame:
    """Blocks of ``size`` as ``_own``, and as ``_other`` the two that lie ``far`` blocks farther on."""
    every = size // BLOCK
    c, at = F.floor(F.col("_b") / every), F.col("_b") % every
    own = F.slice("_z", F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("_n") / 2) - F.col("_b") * BLOCK).cast("int"))
    place = lambda up, role: F.when(c >= up, F.struct((c - up).alias("_c"), F.lit(role).alias("role"), at.alias("at")))
    rows = blocks.select(*HALF, own.alias("_z"), F.explode(F.array_compact(F.array(place(0, 0), place(far, 1), place(far + 1, 2)))).alias("p"))
    pick = lambda role: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(role, F.struct("p.role", "p.at", "_z")))), lambda s: s["_z"]))
    out = rows.groupBy(*HALF, F.col("p._c").alias("_c")).agg(pick(F.col("p.role") == 0).alias("_own"), pick(F.col("p.role") > 0).alias("_other"))
    return out.where((F.size("_own") > 0) & (F.size("_other") > 0))


def chain_ess(df: DataFrame, by: list[str], chain: str, order: str, value: str, common: bool = False) -> DataFrame:
    """(by, ess_bulk, ess_tail): effective sample sizes by Geyer's initial positive and monotone sequences, of the normal scores of split
    chains and of their tails; NaN for chains of different lengths, under six draws, constant or not finite ones.

    ``common``: chains are first cut to the length of the shortest one of their group.  A chain may have any number of draws.
    """
    whole = pieces(df, by, chain, order, value)
    lengths = whole.groupBy(*by, "_chain").agg(F.sum(F.size("_v")).alias("_n"))
    groups = lengths.groupBy(*by).agg(F.min("_n").alias("_n"), (F.lit(common) | (F.min("_n") == F.max("_n"))).alias("_even"))
    groups = cut(groups.withColumn("_g", F.monotonically_increasing_id()))
    rows = joined_by(whole, _small(groups.where("_even and _n >= 6")), by).where("_from < _n")
    rows = rows.select("_g", "_chain", "_n", "_from", F.when(F.col("_from") + F.size("_v") <= F.col("_n"), F.col("_v")).otherwise(F.slice("_v", F.lit(1), F.greatest(F.col("_n") - F.col("_from"), F.lit(0)).cast("int"))).alias("_v"))

    # Scores by distinct value.
    h, i = F.floor(F.col("_n") / 2), F.col("_from") + F.col("_pos")
    half = F.when(i < h, 0).when(i >= F.col("_n") - h, 1)
    single = rows.select("_g", "_chain", "_n", "_from", F.posexplode("_v").alias("_pos", "_v")).withColumns({"_half": half, "_i": i - F.when(half == 1, F.col("_n") - h).otherwise(0)})
    counts = ordered_counts(single, ["_g"], "_v", kept=F.col("_half").isNotNull())
    rank = F.col("_upto") - (F.col("_ties") - 1) / 2
    counts = counts.select("_g", "_v", "_upto_all", "_total_all", F.when(F.col("_c") > 0, (rank - 0.375) / (F.col("_total") + 0.25)).alias("_p"))
    counts = cut(counts.mapInArrow(_scores, StructType([*counts.schema.fields[:-1], StructField("_z", DoubleType())])))
    about = counts.groupBy("_g").agg(
        F.bool_or(~F.coalesce(finite(F.col("_v")), F.lit(False))).alias("_bad"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.min("_z").alias("_zmin"), F.max("_z").alias("_zmax"),
        *[interpolated(p, "_v", "_all").alias(f"_q{k}") for k, p in enumerate(TAILS)],
    ).where("not _bad and _min < _max")
    # A tail is read off the scores, which rise with the values.
    tails = counts.join(_small(about.select("_g", "_q0", "_q1")), "_g").groupBy("_g").agg(*[F.coalesce(F.max(F.when(F.col("_v") <= F.col(f"_q{k}"), F.col("_z"))), F.lit(-math.inf)).alias(c) for k, c in enumerate(("_low", "_high"))])
    about = cut(about.join(tails, "_g").join(groups.select("_g", "_n"), "_g").select("_g", "_n", "_low", "_high", "_zmin", "_zmax"))

    # Blocks of scores.
    live, kind = _small(about.select("_g")), df.schema[chain].dataType
    if counts.count() <= LOOKED_UP:
        schema = StructType([StructField("_g", LongType()), StructField("_chain", kind), StructField("_half", IntegerType()), StructField("_b", LongType()), StructField("_off", IntegerType()), StructField("_z", ArrayType(DoubleType()))])
        parts = rows.join(live, "_g").mapInArrow(_blocks(counts.inputFiles()), schema)
    else:
        b, off = F.floor(F.col("_i") / BLOCK), (F.col("_i") % BLOCK).cast("int")
        places = F.array_compact(F.array(F.struct(b.alias("_b"), off.alias("_off")), F.when((off < HALO) & (b > 0), F.struct((b - 1).alias("_b"), (off + BLOCK).alias("_off")))))
        parts = single.where("_half is not null").join(live, "_g").join(counts.select("_g", "_v", "_z"), ["_g", "_v"]).select(*HALF, F.explode(places).alias("p"), F.array("_z").alias("_z")).select(*HALF, "p.*", "_z")
    blocks = parts.groupBy(*HALF, "_b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_off", "_z"))), lambda s: s["_z"])).alias("_z"))
    blocks = joined_by(cut(blocks), _small(about), ["_g"])

    # Means of the halves, and what varies between them.
    schema = StructType([*[blocks.schema[c] for c in HALF], *[StructField(f"_s{k}", DoubleType()) for k in range(3)]])
    means = blocks.mapInArrow(_totals(), schema).groupBy(*HALF).agg(*[F.sum(f"_s{k}").alias(f"_m{k}") for k in range(3)])
    means = cut(means.join(about, "_g").select(*HALF, *[(F.col(f"_m{k}") / F.floor(F.col("_n") / 2)).alias(f"_m{k}") for k in range(3)]))
    blocks = joined_by(blocks, _small(means), HALF)
    each = means.groupBy("_g").agg(F.count("*").alias("m"), *[F.var_samp(f"_m{k}").alias(f"_b{k}") for k in range(3)]).join(about, "_g")
    moves = [F.col("_zmin") < F.col("_zmax"), *[(F.col(c) >= F.col("_zmin")) & (F.col(c) < F.col("_zmax")) for c in ("_low", "_high")]]
    series = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_b{k}").alias("between"), moves[k].alias("open")) for k in range(3)]))
    none = [F.lit(None).cast("double").alias(c) for c in ("pair", "low", "head", "even")]
    state = each.select("_g", "m", F.floor(F.col("_n") / 2).alias("n"), series.alias("s")).select("_g", "s._k", "n", "m", "s.between", F.lit(None).cast("double").alias("cov"), F.lit(-1).cast("long").alias("t"), *none, "s.open", F.lit(float("nan")).alias("ess"))

    size, far, lags = BLOCK, 0, HALO
    while True:
        if lags == HALO:
            pairs = blocks.withColumns({"_own": F.slice("_z", F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("_n") / 2) - F.col("_b") * BLOCK).cast("int")), "_other": F.col("_z")})
        else:
            pairs = _longer(blocks.join(_small(state.where("open").select("_g").distinct()), "_g", "left_semi"), size, far)
            pairs = joined_by(joined_by(pairs, _small(means), HALF), _small(about), ["_g"])
        found = pairs.select("_g", "_own", "_other", "_low", "_high", "_m0", "_m1", "_m2").mapInArrow(_products(lags), "_g long, _k int, _sums array<double>")
        found = found.select("_g", "_k", F.posexplode("_sums").alias("_lag", "_s")).groupBy("_g", "_k", "_lag").agg(F.sum("_s").alias("_s"))
        found = found.groupBy("_g", "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_lag", "_s"))), lambda s: s["_s"]).alias("_sums"))
        state = cut(state.join(found, ["_g", "_k"], "left").mapInPandas(_sequence(far * size, lags), STATE))
        if state.where("open").isEmpty():
            break
        if size < LONGEST:
            size = lags = size * GROWTH
        else:
            far += 1
    # pandas hands NaN back as null; an unknown size makes the tail's unknown.
    ess, tail = F.coalesce("ess", F.lit(float("nan"))), F.col("_k") > 0
    bulk, tail = F.max(F.when(~tail, ess)), F.when(F.bool_or(tail & F.isnan(ess)), float("nan")).otherwise(F.min(F.when(tail, ess)))
    sizes = state.groupBy("_g").agg(bulk.alias("ess_bulk"), tail.alias("ess_tail"))
    return groups.join(sizes, "_g", "left").select(*by, *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("ess_bulk", "ess_tail")])
