"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, and its LCP intervals.

Lines that occur once can't be part of a repeated run, so only suffixes that begin with a repeated line enter the array; to
them every other line, and every end of a document, is a symbol of its own.  Prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: each round looks up the rank of the suffix h lines further on, sorts the pairs by range
over all tasks (ties broken by place, so that a line with a third of all rows is split) and numbers them from per-task
counts.  Rounds end when no suffix needs a longer prefix.  Which lines repeat, and which place of an interval is the first,
is read off the same kind of sort.

A suffix's depth is the least number of lines that hold ``min_words`` words.  The LCP interval of that depth around a
suffix is the set of suffixes with the same ranks for the two overlapping blocks of 2^k lines that cover it.  The first
place of each interval is kept; the lines of all later ones are marked.

These blocks alone leave the end of a run that holds fewer than ``min_words`` words after the last of them.  With
``maximal``, blocks that end at a line and reach back ``min_words`` words are looked up in the same ranks, and blocks may
begin or end with blank lines.  Every line of a repeated run of ``min_words`` words then lies in a block inside the run:
one that begins with the line, one that ends with it, or the first of the run.  So the marks join up to the maximal
repeated runs, which are deleted.

Places are ordered by doc_id (null last), then by a hash of the text, then by line.  Edge cases: a null text has no lines
and stays null; an empty text has one empty line; rows that repeat both id and text are one document, each gets the same
result; blank lines belong to a run but never make one; runs under ``min_words`` words are left alone; a table without
repeats comes back as it is; columns other than the text are passed on as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.llm.common import Scratch, n_words_of, shuffle_partitions, written

MIN_WORDS = 30
_DOC = ["d", "th"]
#: No line has this rank; symbols of their own get ranks below it.
_OWN = -1


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, th, pos, h1, h2, words) of every line; d and th name the document."""
    rows = docs.where(F.col(text_col).isNotNull()).select(_key(id_col).alias("d"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return rows.select("d", "th", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), n_words_of(F.col("line")).cast("int").alias("words"))


def _key(id_col: str):
    """Ids as longs, null last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))


def _runs(keys: list[str]):
    """Adds to sorted rows their ``number`` within the task, the number ``start`` at which their run of equal keys began, and
    whether the row after them begins a run (``ends``; null for the last row of the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen, begun, last, held = 0, 0, None, None

        def emitted(begins: bool | None) -> pa.RecordBatch:
            batch, number, start, fresh = held
            ends = pa.concat_arrays([pa.array(fresh[1:]), pa.array([begins], pa.bool_())])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(start), ends], names=[*batch.schema.names, "number", "start", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            fresh[0] = last is None or last != [c[0] for c in columns]
            if held:
                yield emitted(bool(fresh[0]))
            number = np.arange(seen, seen + batch.num_rows)
            start = np.maximum.accumulate(np.where(fresh, number, begun))
            held = batch, number, start, fresh
            seen, begun, last = seen + batch.num_rows, int(start[-1]), [c[-1] for c in columns]
        if held:
            yield emitted(None)

    return run


def _sorted_runs(rows: DataFrame, keys: list[str]) -> Scratch:
    """Rows in runs of equal keys, with ``rank`` (the number of rows with a smaller key), ``is_first`` (in order of place) and
    ``is_single``.  Rows are sorted by range over all tasks, ties by place, so that a key with a third of all rows is split."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    ordered = rows.repartitionByRange(n, *keys, *_DOC, "pos").sortWithinPartitions(*keys, *_DOC, "pos").withColumn("task", F.spark_partition_id())
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema] + ["number long", "start long", "ends boolean"])
    numbered = Scratch(ordered.mapInArrow(_runs(keys), schema), "numbered")
    # One row per task: how many rows come before it, where the run began that its first rows continue, and whether its
    # first and last runs go on in its neighbours.
    key = F.struct(*keys)
    parts = numbered.df.groupBy("task").agg(F.count("*").alias("n"), F.max("start").alias("last_start"), F.min_by(key, "number").alias("first"), F.max_by(key, "number").alias("last")).orderBy("task").collect()
    table, base, open_key, open_rank = [], 0, None, 0
    for i, p in enumerate(parts):
        after = parts[i + 1] if i + 1 < len(parts) else None
        goes_on = p["first"] == open_key
        carried = open_rank if goes_on else base
        table.append((p["task"], base, carried, goes_on, after is not None and after["first"] == p["last"]))
        if p["last"] != open_key or p["last_start"] > 0:
            open_rank = carried if p["last_start"] == 0 else base + p["last_start"]
        open_key, base = p["last"], base + p["n"]
    offsets = spark.createDataFrame(table, "t int, base long, carried long, goes_on boolean, stays boolean")  # as many rows as tasks
    rank = F.when(F.col("start") == 0, F.col("carried")).otherwise(F.col("base") + F.col("start"))
    is_first = (F.col("number") == F.col("start")) & ~((F.col("number") == 0) & F.col("goes_on"))
    is_single = is_first & F.coalesce("ends", ~F.col("stays"))
    joined = numbered.df.join(F.broadcast(offsets), F.col("task") == F.col("t")).withColumns({"rank": rank, "is_first": is_first, "is_single": is_single})
    out = Scratch(joined.drop("task", "t", "base", "carried", "goes_on", "stays", "number", "start", "ends", *keys), "ranks")
    numbered.drop()
    return out


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", maximal: bool = False) -> DataFrame:
    """(d, th, pos) of every line that is to be deleted: of blocks that begin with a word or, if ``maximal``, of whole runs."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    first_ranks = _sorted_runs(lines, ["h1", "h2"])
    active = first_ranks.df.where("not is_single").drop("is_first", "is_single")
    # Depth: the least number of lines, all of them repeated ones, that hold min_words words.  A run of places without
    # a gap is looked at through the running sum of its words.
    place = W.partitionBy(*_DOC).orderBy("pos")
    active = active.dropDuplicates([*_DOC, "pos"]).withColumn("stretch", F.col("pos") - F.row_number().over(place))
    inside = W.partitionBy(*_DOC, "stretch").orderBy("pos")
    active = active.withColumn("sofar", F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    active = active.withColumn("sofar", F.coalesce("sofar", F.lit(0)))
    # The first line by which the sum has risen enough is found by merging starts and ends in order of the sum; so is the
    # last line from which it has risen enough by an end.
    ends = active.select(*_DOC, "stretch", "pos", (F.col("sofar") + F.col("words")).alias("at"), F.lit(1).alias("end"), F.col("sofar"))
    starts = active if maximal else active.where("words > 0")
    starts = starts.select(*_DOC, "stretch", "pos", (F.col("sofar") + min_words).alias("at"), F.lit(0).alias("end"), F.col("sofar"))
    merged = W.partitionBy(*_DOC, "stretch").orderBy("at", "end", "pos")
    blocks = ends.unionByName(starts).withColumn("stop", F.min(F.when(F.col("end") == 1, F.col("pos"))).over(merged.rowsBetween(0, W.unboundedFollowing)))
    wanted = (F.col("end") == 0) & F.col("stop").isNotNull()
    first, last = F.col("pos"), F.col("stop")
    if maximal:
        blocks = blocks.withColumn("since", F.max(F.when(F.col("end") == 0, F.struct("pos", "at"))).over(merged.rowsBetween(W.unboundedPreceding, 0)))
        # Where the words up to the line before are too few, the block is the one that begins with its first line.
        wanted = wanted | ((F.col("end") == 1) & (F.col("sofar") >= F.col("since.at")))
        first, last = F.when(F.col("end") == 0, first).otherwise(F.col("since.pos")), F.when(F.col("end") == 0, last).otherwise(F.col("pos"))
    blocks = written(blocks.where(wanted).select(*_DOC, first.alias("pos"), (last - first + 1).alias("depth")), "blocks")
    deepest = blocks.agg(F.max("depth")).first()[0] or 0
    level = Scratch(active.drop("sofar", "stretch", "words"), "ranks")
    found, h = [], 1
    while True:
        # Depths in h .. 2h - 1 are covered by two blocks of h lines.
        now = level.df
        due = blocks.where(f"depth >= {h} and depth < {2 * h}").join(now, [*_DOC, "pos"])
        second = now.select(F.col("d").alias("d2"), F.col("th").alias("th2"), F.col("pos").alias("pos2"), F.col("rank").alias("rank2"))
        due = due.join(second, (F.col("d") == F.col("d2")) & (F.col("th") == F.col("th2")) & (F.col("pos") + F.col("depth") - h == F.col("pos2")))
        # The first place of each interval stays; all later ones are marked.
        found.append(_sorted_runs(due.select(*_DOC, "pos", "depth", F.col("rank").alias("k1"), F.col("rank2").alias("k2"), F.col("depth").alias("k3")), ["k1", "k2", "k3"]).df.where("not is_first"))
        if deepest < 2 * h:
            break
        ahead = now.select(F.col("d").alias("d2"), F.col("th").alias("th2"), (F.col("pos") - h).alias("pos2"), F.col("rank").alias("r2"))
        paired = now.withColumnRenamed("rank", "r1").join(ahead, (F.col("d") == F.col("d2")) & (F.col("th") == F.col("th2")) & (F.col("pos") == F.col("pos2")), "left").drop("d2", "th2", "pos2")
        # What follows may be the end or a line of its own: then no other suffix shares the longer prefix.
        nxt = _sorted_runs(paired.withColumn("r2", F.coalesce("r2", _OWN - F.xxhash64(*_DOC, "pos").bitwiseAND(F.lit(2**62 - 1)))), ["r1", "r2"])
        level.drop()
        level, h = nxt, 2 * h
    level.drop()
    marks = functools.reduce(DataFrame.unionByName, found).withColumn("stop", F.col("pos") + F.col("depth") - 1)
    # Of marks that overlap, each adds the lines that those before it don't have.
    before = F.max("stop").over(W.partitionBy(*_DOC).orderBy("pos", "stop").rowsBetween(W.unboundedPreceding, -1))
    marks = marks.withColumn("from", F.greatest("pos", F.coalesce(before + 1, "pos"))).where(F.col("from") <= F.col("stop"))
    return marks.select(*_DOC, F.explode(F.sequence("from", "stop")).alias("pos"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", maximal: bool = False) -> DataFrame:
    """All columns of ``docs`` with the repeated runs' later copies deleted from the text, plus n_lines and n_deleted.

    Without ``maximal`` the last lines of a run may stay, see above; the query and the pipeline set it.
    """
    gone = written(repeated_lines(docs, min_words, id_col, text_col, maximal), "repeated")
    gone = gone.groupBy("d", "th").agg(F.collect_list("pos").alias("_gone")).withColumnsRenamed({"d": "_d", "th": "_th"})
    # What is deleted grows with the corpus, so it is never broadcast.
    joined = docs.join(gone.hint("merge"), (_key(id_col) == F.col("_d")) & (F.xxhash64(text_col) == F.col("_th")), "left")
    joined = joined.withColumn("_lines", F.split(text_col, "\n"))
    n = F.when(F.col(text_col).isNotNull(), F.size("_lines")).otherwise(F.lit(0))
    # The difference of the line numbers keeps their order.
    left = F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")))
    joined = joined.withColumn("_left", left).withColumn("n_lines", n.cast("long")).withColumn("n_deleted", F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long"))
    text = F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n")
    joined = joined.withColumn(text_col, F.when(F.col("_left").isNull(), F.col(text_col)).otherwise(text))
    return joined.drop("_gone", "_d", "_th", "_lines", "_left")
