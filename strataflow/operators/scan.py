"""Segmented scans over groups of any size: the last value, the value before, and running sums, in an order.

Rows are sorted by range of (group, order) over all tasks, so a group with most of the rows spans many of them.  Each task
streams its rows once and scans them by itself; one more row per task tells what its last group ends with, the driver carries
these few rows over the tasks' borders, and rows of a task's first group take on what came before.  Memory of a task does not grow
with its groups, unlike a window's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from strataflow.operators.scratch import cut

KINDS = ("last", "before", "sum")
_OWN = ["_g1", "_g2"]


def _scan(plan: list[tuple[str, str, str]], names: list[str]):
    """Streams a task's rows; ``plan`` holds (result, kind, column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, key, first, alone, state, kinds = TaskContext.get().partitionId(), None, None, True, {}, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = [batch.column(c).to_numpy() for c in _OWN]
            fresh = np.zeros(n, bool)
            fresh[1:] = (g[0][1:] != g[0][:-1]) | (g[1][1:] != g[1][:-1])
            # The task's first row may go on with the group of the task before.
            fresh[0] = key is not None and key != (g[0][0], g[1][0])
            first = first or (g[0][0], g[1][0])
            place = np.arange(n)
            begun = np.maximum.accumulate(np.where(fresh, place, -1))  # -1: before this batch
            head = (begun < 0) & alone
            found = []
            for out, kind, column in plan:
                values = batch.column(column)
                if kind == "sum":
                    x = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
                    total = np.cumsum(x)
                    base = np.where(begun >= 0, (total - x)[np.maximum(begun, 0)], -state.get(out, 0))
                    own = total - base
                    found.append(pa.array(own, type=values.type))
                    state[out] = own[-1]
                    continue
                upto = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), place, -1))
                at = upto if kind == "last" else np.concatenate(([-1], upto[:-1]))
                # Of the group: in this batch, or held from before it.
                held = (at < begun) | (at < 0)
                none = held & ((begun >= 0) if kind == "last" else ((begun >= 0) | fresh))
                source = pa.concat_arrays([state.get(out, pa.nulls(1, values.type)), values])
                found.append(source.take(pa.array(np.where(held, 0, at + 1), mask=none)))
                end = upto[-1] if upto[-1] >= begun[-1] else -1
                state[out] = values.slice(end, 1) if end >= 0 else (pa.nulls(1, values.type) if begun[-1] >= 0 else source.slice(0, 1))
            alone = alone and begun[-1] < 0
            key = (g[0][-1], g[1][-1])
            kinds = [c.type for c in batch.columns]
            own = [pa.array(np.full(n, task, np.int32)), pa.array(head), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found, *own], names=names)
        if key is not None:
            # The task's last row is no row of the table: it tells the first group, the last one, and what that ends with.
            ends = [pa.array([state[out]], values) if kind == "sum" else state[out] for (out, kind, column), values in zip(plan, [kinds[names.index(c)] for _, _, c in plan], strict=True)]
            empty = [pa.array([key[_OWN.index(c)]], t) if c in _OWN else pa.nulls(1, t) for c, t in zip(names, kinds, strict=False)]
            own = [pa.array([task], pa.int32()), pa.array([alone]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, *ends, *own], names=names)

    return run


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[Column], scans: dict[str, tuple[str, str]]) -> DataFrame:
    """All columns and, per entry ``result: (kind, column)``, over the rows of the same group in the given order:

    ``last``: the last value that isn't null, the row's own included; ``before``: the same without the row's own;
    ``sum``: the sum up to and with the row, nulls as 0.  Rows that are equal in the order stand in any order.
    """
    spark = df.sparkSession
    if bad := [k for k, _ in scans.values() if k not in KINDS]:
        raise ValueError(f"a scan is one of {KINDS}, not {bad}")
    # Groups are told apart by two hashes; a null counts as a value of its own.
    parts = [c for name in by for c in (F.col(name), F.col(name).isNull())] or [F.lit(0)]
    rows = df.withColumns({"_g1": F.xxhash64(*parts), "_g2": F.hash(*parts), "_tie": F.monotonically_increasing_id()})
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order, F.col("_tie").asc()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    for _, column in scans.values():
        if ranged.schema[column].dataType.simpleString() in ("int", "smallint", "tinyint"):
            ranged = ranged.withColumn(column, F.col(column).cast("long")) if any(k == "sum" and c == column for k, c in scans.values()) else ranged
    schema = StructType([StructField(f.name, f.dataType) for f in ranged.schema])
    for out, (kind, column) in scans.items():
        if kind == "sum" and not isinstance(ranged.schema[column].dataType, LongType | DoubleType):
            raise ValueError(f"{column} must hold whole numbers or doubles to be summed")
        schema = schema.add(out, ranged.schema[column].dataType)
    schema = schema.add("_task", IntegerType()).add("_head", BooleanType()).add("_f1", LongType()).add("_f2", LongType())
    plan = [(out, kind, column) for out, (kind, column) in scans.items()]
    table = cut(ranged.mapInArrow(_scan(plan, schema.names), schema))
    found = table.where(F.col("_f1").isNotNull()).select("_task", "_head", *_OWN, "_f1", "_f2", *scans).collect()  # a row per task
    carried, open_key, state = [], None, {}
    for r in sorted(found, key=lambda r: r["_task"]):
        now = state if (r["_f1"], r["_f2"]) == open_key else {}
        carried.append((r["_task"], *[now.get(out) for out, _, _ in plan]))
        state = {}
        for out, kind, _ in plan:
            end, before = r[out], now.get(out) if r["_head"] else None
            state[out] = (end + (before or 0)) if kind == "sum" else before if end is None else end
        open_key = (r["_g1"], r["_g2"])
    kinds = StructType().add("_task", IntegerType())
    for out, _, column in plan:
        kinds = kinds.add(f"_c_{out}", schema[out].dataType)
    joined = table.where(F.col("_f1").isNull()).join(F.broadcast(spark.createDataFrame(carried, kinds)), "_task")  # a row per task
    for out, kind, _ in plan:
        add = F.when(F.col("_head"), F.col(f"_c_{out}"))
        joined = joined.withColumn(out, F.col(out) + F.coalesce(add, F.lit(0).cast(schema[out].dataType)) if kind == "sum" else F.coalesce(F.col(out), add))
    return joined.select(*df.columns, *scans)
