"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Targets: sources share ``epochs`` times all words by weight, none above ``cap`` times its own size; what a capped source
can't take is shared again by weight.  The fixed point is found at once: sources whose cap per weight is least are capped
first, and the level that the others reach is what is left over the weight that is left.

Curriculum: a source's weight changes over training time t in 0..1 along a piecewise linear schedule.  Its integral up to
t, scaled to the source's target, is the demand for its words up to t.  The documents of a source lie one after another
along that demand, in passes over the source; inverting the demand at the middle of the words that a pass takes of a
document gives the training position of that copy.  Results are range-sorted by position.

Edge cases: a null or blank text has size 0 and takes nothing; what takes nothing has no copy and so no position in
``schedule`` and ``curriculum``, while ``mixture`` gives the place where it would lie; a null source is a source of its own
and sorts last; rows that repeat an id are documents of their own; an empty table, or one without a
word, gives targets of 0; a null id sorts last; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.llm.common import n_words_of, never_null, slot_bases, written

WEIGHTS = (5, 2, 1)
EPOCHS = (3, 2)  # 150 percent
CAP = 2
SLOTS = 1024
#: Knots (t, height) of each weight rank's schedule: heavy sources fade, light ones rise.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: tuple[int, int] = EPOCHS, cap: int = CAP) -> DataFrame:
    """(source, rank, weight, source_size, target) from rows (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    sums = sums.withColumn("rank", rank)
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    # Least cap per weight first.
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    upto, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = sums.withColumn("total", F.sum("source_size").over(everything) * epochs[0] / epochs[1])
    sums = sums.withColumn("spare", F.col("total") - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    sums = sums.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    full = F.col("spare") * F.col("weight") >= cap * F.col("source_size") * F.col("open")
    # The level is set by the first source that stays below its cap; sources before it are capped.
    level = F.first(F.when(~full, F.col("spare") / F.col("open")), ignorenulls=True).over(everything)
    target = F.least(F.coalesce(level * F.col("weight"), (cap * F.col("source_size")).cast("double")), (cap * F.col("source_size")).cast("double"))
    return sums.select("source", "rank", "weight", "source_size", target.alias("target"))


def _integrals(knots: tuple[tuple[float, float], ...]) -> list[float]:
    total, out = 0.0, [0.0]
    for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
        total += (t1 - t0) * (h0 + h1) / 2
        out.append(total)
    return out


def position_at(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a schedule has reached ``share`` (0..1) of its whole."""
    sums = _integrals(knots)
    out = F.lit(1.0)
    area = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * sums[-1]
    for i in range(len(knots) - 2, -1, -1):
        (t0, h0), (t1, h1) = knots[i], knots[i + 1]
        a, slope = area - sums[i], (h1 - h0) / (t1 - t0)
        root = F.sqrt(F.greatest(h0 * h0 + 2 * slope * a, F.lit(0.0)))
        # The form that is stable for small slopes: 2a / (h0 + root).
        step = F.when(h0 + root > 0, 2 * a / (h0 + root)).otherwise(F.lit(0.0))
        out = F.when(area <= sums[i + 1], F.least(t0 + step, F.lit(float(t1)))).otherwise(out)
    return out


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: tuple[int, int] = EPOCHS, cap: int = CAP, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies and place; with ``carry`` also
    ``row``, a struct of all columns of ``docs``.

    ``copies`` has the words and the training position of each pass that takes the document; ``place`` is where its first
    pass would lie, whether it is taken or not.

    The documents of a source are ordered by a digest of their id and dealt into ``slots``; sums per slot are made
    before any shuffle of rows, so that a source with a third of all documents is spread over all tasks.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    carried = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size"), digest.alias("digest"), F.xxhash64(text_col).alias("th"), *carried)
    rows = rows.withColumn("slot", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * slots / 2**32).cast("int")).withColumn("key", never_null(F.col("source")))
    sizes = written(rows.drop("row"), "sizes")
    if not carry:
        rows = sizes
    targets = written(source_targets(sizes, weights, epochs, cap), "targets")
    # Each (source, slot) knows what its source's earlier slots hold, and the source's target: rows meet both in one join,
    # whose partitioning also serves the order inside the slot.
    by_slot = slot_bases(sizes, ["key"], "slot", "size", "base")
    by_slot = by_slot.join(targets.select(never_null(F.col("source")).alias("key"), "rank", "source_size", "target"), "key")
    inside = W.partitionBy("key", "slot").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size", "th").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(by_slot, ["key", "slot"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.floor("target").cast("long")

    def within(passes: int) -> Column:
        """Words of this document that lie below the target in the given pass over its source."""
        return F.greatest(F.least(goal - passes * F.col("source_size") - F.col("before"), F.col("size")), F.lit(0))

    taken = sum((within(p) for p in range(1, cap)), within(0))
    kind = F.col("rank") % len(schedules)

    def position(middle: Column) -> Column:
        """When the source's demand reaches so many words."""
        share = F.when(F.col("target") > 0, middle / F.col("target")).otherwise(F.lit(0.0))
        out = position_at(share, schedules[-1])
        for i, knots in list(enumerate(schedules))[:-1]:
            out = F.when(kind == i, position_at(share, knots)).otherwise(out)
        return F.round(out, 9)

    copies = [F.when(within(p) > 0, F.struct(within(p).cast("long").alias("words"), position(F.col("before") + p * F.col("source_size") + within(p) / 2).alias("position"))) for p in range(cap)]
    place = position(F.col("before") + F.col("size") / 2)
    return placed.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), F.array_compact(F.array(*copies)).alias("copies"), place.alias("place"), *(["row"] if carry else []))


def mixture(docs: DataFrame, *args, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and position (its place), sorted by position."""
    out = schedule(docs, *args, **options).drop("copies").withColumnRenamed("place", "position")
    return written(out, "mixture").orderBy("position", F.col("doc_id").asc_nulls_last())


def curriculum(docs: DataFrame, cap: int = CAP, **options) -> DataFrame:
    """As :func:`mixture`, but with the position of each copy: position, position_2, ... up to ``cap``, null where none is taken."""
    names = ["position", *[f"position_{p}" for p in range(2, cap + 1)]]
    out = schedule(docs, cap=cap, **options)
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", *[F.get("copies", F.lit(p))["position"].alias(n) for p, n in enumerate(names)])
    return written(out, "curriculum").orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
