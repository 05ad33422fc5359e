"""Projections of event logs and line lists: forests, tips, migration, sojourns, cohorts, sampling."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.checks import refuse_any
from strataflow.operators.joins import parent_edges
from strataflow.operators.scan import scanned
from strataflow.operators.scratch import cut
from strataflow.operators.tours import newick_pieces, tours
from strataflow.operators.windows import cohort_bins


def forest(rows: DataFrame, individual: str, parent: str, time: str) -> DataFrame:
    """(child, parent, time): first edge of each individual; roots have no parent."""
    return parent_edges(rows, individual, parent, time)


def leaves(edges: DataFrame) -> DataFrame:
    """Individuals that nobody has as a parent."""
    return edges.join(edges.where("parent is not null").select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select("child", "time")


def with_root(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(child, root, depth) by pointer doubling: the number of joins is the logarithm of the deepest chain.  Each round is
    written to the shared folder, so that plans stay short."""
    now = edges.select("child", F.coalesce("parent", "child").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(rounds):
        above = now.select(F.col("child").alias("_c"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        nxt = cut(now.join(above, now.up == above["_c"], "left").select("child", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.coalesce("_d", F.lit(0)) > 0).alias("moved")))
        moved = not nxt.where("moved").isEmpty()
        now = nxt.drop("moved")
        if not moved:
            return now.select("child", F.col("up").alias("root"), "depth")
    raise ValueError("the parent links have a cycle or are too deep")


def tree_shape(edges: DataFrame) -> DataFrame:
    """Per root: nodes, tips, Sackin index (sum of the tips' depths) and branch length (sum of child minus parent times)."""
    rooted = with_root(edges)
    tips = leaves(edges).select("child", F.lit(True).alias("tip"))
    times = edges.select(F.col("child").alias("parent"), F.col("time").alias("_pt"))
    lengths = edges.join(times, "parent", "left").select("child", F.coalesce(F.col("time") - F.col("_pt"), F.lit(0.0)).alias("branch"))
    rows = rooted.join(tips, "child", "left").join(lengths, "child")
    tip = F.coalesce("tip", F.lit(False))
    return rows.groupBy("root").agg(F.count("*").alias("n_nodes"), F.count_if(tip).alias("n_tips"), F.sum(F.when(tip, F.col("depth")).otherwise(0)).alias("sackin"), F.sum("branch").alias("branch_length"))


def pruned(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """Edges that lead to a sampled individual: those with one in their subtree, counted along the trees' tours."""
    marked = edges.join(sampled.select("child").distinct().withColumn("_hit", F.lit(1)), "child", "left")
    hit = tours(marked, {"hits": F.col("_hit")}).where("hits > 0 and known").select("child")
    return cut(edges.join(hit, "child", "left_semi"))


def compressed(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """Adds ``keep``: tips, sampled nodes, branch points and roots stay; nodes with one child are passed through."""
    kids = edges.where("parent is not null").groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("kids"))
    rows = edges.join(kids, "child", "left").join(sampled.select("child", F.lit(True).alias("sampled")).distinct(), "child", "left")
    return rows.withColumn("keep", F.coalesce("sampled", F.lit(False)) | F.col("parent").isNull() | (F.coalesce("kids", F.lit(0)) != 1)).withColumn("pendant", F.coalesce("sampled", F.lit(False)) & (F.coalesce("kids", F.lit(0)) > 0))


def merged(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """(node, parent, time, branch, is_tip, individual) of the trees that lead to sampled individuals.

    ``sampled`` has (child, sampled_at).  Nodes that were not sampled and have one child on such a path are passed through, and
    their branch is added to the child's.  A sampled individual without children on a path is a tip at its sampling time; one
    with children stays a node at its own time and gets a pendant tip, a node of its own with a negative number.  A branch
    is missing above the first node of a tree that stays.
    """
    paths = pruned(edges, sampled)
    kids = paths.where("parent is not null").groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("kids"))
    rows = paths.join(kids, "child", "left").join(sampled.select("child", F.lit(True).alias("own")).distinct(), "child", "left")
    own, several = F.coalesce("own", F.lit(False)), F.coalesce("kids", F.lit(0))
    kept = cut(rows.select("child", "parent", "time", (own | (several != 1)).alias("keep"), (own & (several > 0)).alias("pendant")))
    # The nearest ancestor that stays: chains of passed nodes are cut short by pointer doubling.
    now = kept.select("child", F.col("parent").alias("up"))
    passed = cut(kept.where("not keep").select(F.col("child").alias("_c"), F.col("parent").alias("_up")))
    for _ in range(64):
        nxt = cut(now.join(passed, now.up == passed["_c"], "left").select("child", F.when(F.col("_c").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up"), F.col("_c").isNotNull().alias("moved")))
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
        hop = passed.select(F.col("_c").alias("_c2"), F.col("_up").alias("_up2"))
        passed = cut(passed.join(hop, passed["_up"] == hop["_c2"], "left").select("_c", F.when(F.col("_c2").isNotNull(), F.col("_up2")).otherwise(F.col("_up")).alias("_up")))
    else:
        raise ValueError("the forest is too deep")
    times = edges.select(F.col("child").alias("_p"), F.col("time").alias("_pt"))
    # A branch begins at the parent of the first node that was passed: the nearest ancestor that stays, or above the root nothing.
    rows = kept.where("keep").join(now, "child").join(sampled.select("child", "sampled_at").distinct(), "child", "left")
    rows = rows.join(times, F.col("up") == F.col("_p"), "left")
    tip = F.col("sampled_at").isNotNull() & ~F.col("pendant")
    at = F.when(tip, F.col("sampled_at")).otherwise(F.col("time"))
    nodes = rows.select(F.col("child").alias("node"), F.col("up").alias("parent"), at.alias("time"), (at - F.col("_pt")).alias("branch"), tip.alias("is_tip"), F.col("child").alias("individual"))
    hanging = rows.where("pendant").select((-F.col("child") - 1).alias("node"), F.col("child").alias("parent"), F.col("sampled_at").alias("time"), (F.col("sampled_at") - F.col("time")).alias("branch"), F.lit(True).alias("is_tip"), F.col("child").alias("individual"))
    return nodes.unionByName(hanging)


def newick(edges: DataFrame, rooted: DataFrame | None = None) -> DataFrame:
    """(root, newick): the pieces of each tree's tour in order; of the trees in ``rooted`` alone, where it is given.

    A tree's text is one value here; :func:`newick_pieces` leaves it in pieces.
    """
    pieces = newick_pieces(tours(edges))
    if rooted is not None:
        pieces = pieces.join(rooted.select("root").distinct(), "root", "left_semi")
    return pieces.groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), "").alias("newick"))


def cross_deme_fraction(rows: DataFrame, deme: str, parent_deme: str) -> DataFrame:
    """Share of transmissions whose parent was in another deme; missing without transmissions."""
    return rows.where(F.col(parent_deme).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(parent_deme) != F.col(deme)).cast("double")).alias("cross_deme_fraction"))


def migrations(rows: DataFrame, individual: str, time: str, deme: str) -> DataFrame:
    """One row per change of deme, with the deme before it."""
    moved = scanned(rows.select(individual, time, F.struct(deme).alias("_d")), [individual], [F.col(time).asc()], {"_from": ("before", "_d")})
    before, now = F.col("_from").getField(deme), F.col("_d").getField(deme)
    return moved.where(before != now).select(individual, time, before.alias("from_deme"), now.alias("to_deme"))


def deme_at(rows: DataFrame, individual: str, time: str, deme: str, at: float) -> DataFrame:
    return rows.where(F.col(time) <= at).groupBy(individual).agg(F.max_by(deme, time).alias("deme"))


def individuals(rows: DataFrame, individual: str, time: str, deme: str) -> DataFrame:
    """First and last event, number of events, first and last deme."""
    return rows.groupBy(individual).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_events"), F.min_by(deme, time).alias("first_deme"), F.max_by(deme, time).alias("last_deme"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed, the same in any partition."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def sample(rows: DataFrame, individual: str, seed: int, rate: float | None = None, rates: DataFrame | None = None, deme: str | None = None) -> DataFrame:
    """Individuals whose uniform lies under the rate, flat or by deme."""
    u = rows.withColumn("_u", uniform(F.col(individual), seed))
    if rates is None:
        return u.where(F.col("_u") < rate).drop("_u")
    return u.join(rates, deme).where(F.col("_u") < F.col("rate")).drop("_u", "rate")


def sojourns(rows: DataFrame, individual: str, time: str, kind: Column) -> DataFrame:
    """Stays: each first unmatched entry is paired with the next exit; a stay without exit is right-censored.

    ``kind`` is 1 for an entry, -1 for an exit, else 0 or null.  Exits without an entry are ignored.  One individual may have
    most of the rows.
    """
    seen = scanned(rows.select(individual, time, kind.alias("_k")).where("_k in (1, -1)"), [individual], [F.col(time).asc()], {"_prev": ("before", "_k")})
    # Entries that follow an entry and exits that follow no entry change nothing.
    turns = seen.where("(_k = 1 and coalesce(_prev, -1) = -1) or (_k = -1 and _prev = 1)")
    turns = scanned(turns, [individual], [F.col(time).desc()], {"out_time": ("before", time)})
    stays = turns.where("_k = 1").select(individual, F.col(time).alias("in_time"), "out_time")
    return stays.withColumn("dwell", F.col("out_time") - F.col("in_time")).withColumn("censored", F.col("out_time").isNull())


def cohorts(rows: DataFrame, by: list[str], time: str, width: float, from_zero: bool = False) -> DataFrame:
    return cohort_bins(rows, by, time, width, from_zero)


def log_likelihood(rows: DataFrame, by: list[str], log_probability: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(log_probability).alias("log_likelihood"), F.count(log_probability).alias("n"))


def encode_deme(rows: DataFrame, dims: list[tuple[str, int]], out: str = "deme") -> DataFrame:
    """Mixed-radix code of several level numbers (0-based)."""
    code = F.lit(0).cast("long")
    for column, size in dims:
        code = code * size + F.col(column)
    return rows.withColumn(out, code)


def event_order_violations(rows: DataFrame, individual: str, time: str, sequence: str) -> DataFrame:
    """Rows whose time lies before that of the event recorded before them."""
    before = F.lag(time).over(W.partitionBy(individual).orderBy(sequence))
    return rows.withColumn("_b", before).where(F.col("_b") > F.col(time)).drop("_b")


def require_order(rows: DataFrame, individual: str, time: str, sequence: str) -> DataFrame:
    refuse_any(event_order_violations(rows, individual, time, sequence), "events are out of order")
    return rows


def _replay(names: list[str], seed: int):
    """Streams a task's events, run after run; ``names``: those of the run's column and of the result's."""

    def run(batches):
        import math
        from array import array
        from bisect import bisect_right
        from itertools import accumulate

        import numpy as np
        import pyarrow as pa

        def values(column):
            """Off the buffers at once: to_pylist makes an object of each value first, and of each pair of a map."""
            if not column.null_count or pa.types.is_string(column.type):
                return column.to_numpy(zero_copy_only=False).tolist()
            found = column.fill_null(0).to_numpy().astype(object)
            found[column.is_null().to_numpy(zero_copy_only=False)] = None
            return found.tolist()

        def word():
            nonlocal stock
            if not stock:
                stock = bits.random_raw(4096).tolist()[::-1]
            return stock.pop()

        def below(n):
            """The generator's own rule for integers under ``n``, from words drawn many at a time; a call of it costs several times as much."""
            nonlocal half
            if n == 1:
                return 0
            while True:
                if half is None:
                    x = word()
                    x, half = x & 0xFFFFFFFF, x >> 32
                else:
                    x, half = half, None
                product = x * n
                rest = product & 0xFFFFFFFF
                if rest >= n or rest >= (2**32 - n) % n:
                    return product >> 32

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        now, pools, fresh, bits, stock, half = None, {}, 0, None, [], None
        # Weights that stay the same, over pools of which none has begun or run dry, are summed once.
        last, masses, demes, sums, total = None, {}, [], [], 0.0
        for batch in batches:
            who, parents, to, sources, logs = [], [], [], [], []
            runs, steps, marks, start, goal = (values(batch.column(c)) for c in (0, 1, 3, 4, 5))
            ends, names_of, masses_of = (values(x) for x in (batch.column(6).offsets, batch.column(6).keys, batch.column(6).items))
            for r, step, kind, deme, target, a, b in zip(runs, steps, marks, start, goal, ends, ends[1:], strict=False):
                if r != now or bits is None:
                    now, pools, fresh, bits, stock, half, last = r, {}, 0, np.random.PCG64([seed, r]), [], None, None
                if deme is None or (kind == "move" and target is None):
                    raise ValueError(f"run {r}, step {step}: no deme")
                pool = pools.get(deme)
                if kind == "birth":
                    weights = (names_of[a:b], masses_of[a:b])
                    if weights != last:
                        masses = {k: v for k, v in zip(*weights, strict=True) if v is not None and v > 0 and pools.get(k)}
                        total, demes, last = sum(masses.values()), sorted(masses), weights
                        sums = list(accumulate(masses[k] for k in demes))
                    parent, source, log = None, None, 0.0
                    if demes:
                        source = demes[min(bisect_right(sums, (word() >> 11) * 2.0**-53 * total), len(demes) - 1)]
                        members = pools[source]
                        parent = members[below(len(members))]
                        log = math.log(masses[source] / total / len(members))
                    individual, fresh = fresh, fresh + 1
                    target = deme
                else:
                    if not pool:
                        raise ValueError(f"run {r}, step {step}: deme {deme} has no member")
                    i = below(len(pool))
                    individual, pool[i] = pool[i], pool[-1]
                    pool.pop()
                    parent, source, log = None, None, -math.log(len(pool) + 1)
                    if not pool:
                        last = None
                    if kind != "move":
                        target = deme
                if kind in ("birth", "move"):
                    if not (into := pools.setdefault(target, array("q"))):
                        last = None
                    into.append(individual)
                who.append(individual)
                parents.append(parent)
                to.append(target)
                sources.append(source)
                logs.append(log)
            found = [pa.array(x, t) for x, t in zip((who, parents, to, sources, logs), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *found], names=names)

    return run


def realize(events: DataFrame, run: str = "run", seed: int = 0) -> DataFrame:
    """Give individuals to counted events: (run, step, time, kind, individual, parent, deme, parent_deme, logprob).

    Events: run, step, time, kind ('birth', 'move', 'end'), deme, to_deme, weights (map from deme to the mass of its
    members as parents).  Pools are replayed in order, each draw from what the draws before have left, so one run is one
    task's stream; runs are independent and spread over tasks.  A task holds eight bytes per living member, and no events.
    """
    schema = f"{run} long, step long, time double, kind string, individual long, parent long, deme long, parent_deme long, logprob double"
    own = {"step": "long", "time": "double", "kind": "string", "deme": "long", "to_deme": "long", "weights": "map<long,double>"}
    rows = events.select(F.col(run).cast("long").alias(run), *[F.col(c).cast(t).alias(c) for c, t in own.items()])
    rows = rows.repartition(run).sortWithinPartitions(run, F.col("step").asc_nulls_last(), F.col("time").asc_nulls_last())
    return rows.mapInArrow(_replay([run, "step", "time", "kind", "individual", "parent", "deme", "parent_deme", "logprob"], seed), schema)
