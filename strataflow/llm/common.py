"""Helpers shared by the training-data operators: scratch tables, prefix sums, Arrow slicing."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word, for every operator here: a maximal run of characters other than these six.
SPACE_CLASS = r"[\x09-\x0D\x20]"
SPACE_CHARS = "\t\n\x0b\x0c\r "
#: Bytes of text that one vectorised step inside a task works on.
SLICE_BYTES = 8 << 20
#: The same for steps that hold many arrays over all words of a slice, so that a worker stays small.
WORD_SLICE_BYTES = 2 << 20
#: Rows of a written table are numbered by task and, below these bits, by place.
ROW_BITS = 33

_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: ``spark.checkpoint.dir``.

    Where the setting is missing and Spark runs in one process (tests), a temporary folder stands in.  On a cluster a
    missing setting is an error, because a machine-local folder would not be seen by the other executors.
    """
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        own = tempfile.TemporaryDirectory(prefix="strataflow-")
        atexit.register(own.cleanup)
        _own_dirs[sc.applicationId] = "file://" + own.name
    return _own_dirs[sc.applicationId]


_recorders: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recorders", default=())


@contextlib.contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Every path that :func:`scratch_path` gives inside the block is added to ``paths``, so that its maker can drop it."""
    token = _recorders.set((*_recorders.get(), paths))
    try:
        yield
    finally:
        _recorders.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/strataflow-{app}/{label}-{uuid.uuid4().hex[:12]}"
    for paths in _recorders.get():
        paths.append(path)
    return path


def filesystem(uri: str):
    """(file system, path) of a URI of the shared folder, for tasks that read or write files of their own."""
    import pyarrow.fs as pafs

    # Hadoop's name for S3 is not pyarrow's.
    return pafs.FileSystem.from_uri("s3" + uri.removeprefix("s3a") if uri.startswith("s3a://") else uri)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that :func:`scratch_path` gave."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A written table that cuts lineage and survives the loss of executors; ``drop`` deletes it once superseded."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def numbered(df: DataFrame, label: str) -> Scratch:
    """``df`` written with a number ``_row`` for every row: its task's number, shifted by ``ROW_BITS``, and its place in the task's file."""
    return Scratch(df.withColumn("_row", F.monotonically_increasing_id()), label)


def visit_rows(table: Scratch, asks: DataFrame, columns: list[str], visit: Callable, schema: str) -> DataFrame:
    """Bring ``asks``, which have a ``_row``, to the rows of a table that :func:`numbered` wrote, without moving these.

    The asks of a file meet in one task in order of ``_row`` and their other columns, and that task streams the file from the
    shared folder: ``visit(batches, asks)`` gets iterators over the file's record batches (``_row`` and ``columns``) and over the
    asks' batches, and yields record batches of ``schema``.  Every file is visited, whether it has asks or not.
    """
    names = asks.columns
    heads = table.df.select((F.col("_row").bitwiseAND(F.lit(-1 << ROW_BITS))).alias("_file"), F.col("_metadata.file_path").alias("_path"))
    heads = heads.groupBy("_file").agg(F.min("_path").alias("_path"))
    rest = asks.withColumn("_file", F.col("_row").bitwiseAND(F.lit(-1 << ROW_BITS)))
    both = rest.unionByName(heads, allowMissingColumns=True)
    files = max(1, len(table.df.inputFiles()))
    both = both.repartitionById(files, F.shiftright("_file", ROW_BITS).cast("int")).sortWithinPartitions("_file", F.col("_path").asc_nulls_last(), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for path, own in _by_file(batches):
            fs, where = filesystem(path)
            with fs.open_input_file(where) as f, pq.ParquetFile(f) as file:
                yield from visit(file.iter_batches(batch_size=512, columns=["_row", *columns]), (b.select(names) for b in own))
                for _ in own:  # asks that the visitor left
                    pass

    def _by_file(batches):
        """(path, iterator of asks) of each file; the first row of a file is the one with its path."""
        held: list[pa.RecordBatch] = []
        source = iter(batches)

        def more() -> bool:
            for b in source:
                if b.num_rows:
                    held.append(b)
                    return True
            return False

        while held or more():
            head = held.pop(0)
            number, path = head.column("_file")[0], head.column("_path")[0].as_py()
            if head.num_rows > 1:
                held.insert(0, head.slice(1))

            def own():
                import numpy as np

                while held or more():
                    b = held[0]
                    ends = int(np.searchsorted(b.column("_file").to_numpy(), number.as_py(), side="right"))
                    held.pop(0)
                    if ends < b.num_rows:
                        held.insert(0, b.slice(ends))
                    if ends:
                        yield b.slice(0, ends)
                    if ends < b.num_rows:
                        return

            yield path, own()

    return both.mapInArrow(released(run), schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    return Scratch(df, label).df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def n_words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def never_null(column: Column) -> Column:
    """A text key with a value of its own for null, so that joins and windows on it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def running_sum(df: DataFrame, group: list[str], order: list, slot: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before, in order of (slot, order).

    ``slot`` must be a function of the first order column that never decreases with it; groups and slots are never null.
    Sums per (group, slot) are made map-side first, so that a group with a third of all rows is spread over its slots.
    """
    joined = df.join(slot_bases(df, group, slot, value, "_base"), [*group, slot])
    inside = W.partitionBy(*group, slot).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def slot_bases(df: DataFrame, group: list[str], slot: str, value: str, out: str) -> DataFrame:
    """(group, slot, out): the sum of ``value`` over the earlier slots of the group."""
    sums = df.groupBy(*group, slot).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*group).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*group, slot, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(out))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each slice hold about ``limit`` bytes; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def released(run: Callable) -> Callable:
    """``run`` over a task's record batches; at the end Arrow's unused memory goes back, which an idle worker would keep."""

    def whole(*batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(*batches)
        pa.default_memory_pool().release_unused()

    return whole


def large_text(column: pa.Array) -> pa.Array:
    """Texts without nulls and with 64-bit offsets, in buffers of their own: kernels for strings misread some slices."""
    import numpy as np
    import pyarrow.compute as pc

    whole = pc.fill_null(column.cast(pa.large_string()), "")
    return whole.take(pa.array(np.arange(len(whole))))


def mix64(x):
    """A bijective mixing of uint64 values (numpy)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
