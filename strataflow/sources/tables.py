"""Readers: keyed tables, dimensions, observation files, sweeps, draws, trajectories, event logs, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strataflow.checks import Refused, refuse_any
from strataflow.functions.arithmetic import finite
from strataflow.functions.calendar import parse_iso
from strataflow.operators.scratch import cut

MISSING = "NA"


def separator(path: str) -> str:
    if path.endswith((".tsv", ".tsv.gz")):
        return "\t"
    if path.endswith((".csv", ".csv.gz")):
        return ","
    raise Refused(f"{path}: the name must end in .tsv or .csv")


def read_keyed(spark: SparkSession, path: str, keys: list[str], values: list[str], comment: str | None = None) -> DataFrame:
    """A long-format file with a header: keys are text, values numbers; ``NA`` is missing.  Columns bind by name."""
    header = spark.read.csv(path, sep=separator(path), header=True, comment=comment).limit(0).columns
    if lost := [c for c in (*keys, *values) if c not in header]:
        raise Refused(f"{path} has no column {', '.join(lost)}")
    # The file's columns are in header order; those not asked for are never parsed further.
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in values else T.StringType()) for c in header])
    return spark.read.csv(path, sep=separator(path), header=True, schema=schema, comment=comment, nullValue=MISSING, mode="FAILFAST", enforceSchema=True).select(*keys, *values)


def split_values(df: DataFrame, keys: list[str], values: list[str]) -> dict[str, DataFrame]:
    """One table per value column."""
    return {v: df.select(*keys, F.col(v).alias("value")) for v in values}


def bind_cells(cells: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exactly one finite number for each cell; missing, repeated or unknown cells are refused."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(value).alias(value))
    both = cells.withColumn("_c", F.lit(True)).join(counted, keys, "full_outer")
    bad = both.where(F.col("_c").isNull() | F.col("_n").isNull() | (F.col("_n") > 1) | ~finite(F.col(value).cast("double")))
    refuse_any(bad, "a table needs one number for each cell")
    return both.select(*keys, F.col(value).cast("double").alias(value))


def read_series(rows: DataFrame, time: str, value: str, stratum: str | None = None, level: str | None = None, scale: float = 1.0) -> DataFrame:
    """(time, value) of one stratum in the model's unit; a level without rows is refused."""
    if stratum is not None:
        rows = rows.where(F.col(stratum) == level)
        if not rows.limit(1).count():
            raise Refused(f"no rows for {stratum} = {level}")
    return rows.select(F.col(time).cast("double").alias("time"), (F.col(value) * scale).alias("value"))


def wide_to_long(df: DataFrame, time: str, streams: list[str]) -> DataFrame:
    """One row per time and stream."""
    return df.unpivot([time], streams, "stream", "value")


def route(rows: DataFrame, strata: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their stratum; rows of unknown strata are refused."""
    refuse_any(rows.join(strata, keys, "left_anti"), "a row names an unknown stratum")
    return rows.join(strata, keys)


def time_axis(df: DataFrame, column: str, origin: str | None, unit: str = "days") -> DataFrame:
    """Adds ``t``: numbers as they are, dates from the origin; a mixed column is refused."""
    c = F.col(column).cast("string")
    number, date = c.try_cast("double"), parse_iso(c, origin or "1970-01-01", unit)
    kinds = df.agg(F.count_if(date.isNotNull()).alias("d"), F.count_if(date.isNull() & number.isNotNull()).alias("n"), F.count_if(c.isNotNull() & date.isNull() & number.isNull()).alias("x")).first()
    if kinds["x"] or (kinds["d"] and kinds["n"]):
        raise Refused(f"{column} must hold numbers only or ISO dates only")
    if kinds["d"] and origin is None:
        raise Refused(f"{column} holds dates; an origin is needed")
    return df.withColumn("t", date if kinds["d"] else number)


def design_rows(df: DataFrame) -> DataFrame:
    """Rows of a prospective design: windows and auxiliary columns without an outcome."""
    return df.withColumn("y", F.lit(None).cast("double"))


def numbered_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the place of each row in an order, from 0: rows are sorted by range and numbered from the sizes of the tasks."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_task", before.alias("_before"))  # as many rows as tasks
    rows = placed.withColumn("_task", task).join(F.broadcast(sizes), "_task")
    return rows.withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_task", "_before")


def sweep_points(df: DataFrame, parameters: list[str]) -> DataFrame:
    """Design points with an id; repeated points, repeated ids and values that are not numbers are refused."""
    points = df
    if "point_id" not in df.columns:
        points = numbered_rows(df, parameters, "point_id")
    refuse_any(points.groupBy(*parameters).count().where("count > 1"), "a point occurs twice")
    refuse_any(points.groupBy("point_id").count().where("count > 1"), "a point id occurs twice")
    wrong = F.lit(False)
    for p in parameters:
        wrong = wrong | ~finite(F.col(p).cast("double"))
    refuse_any(points.where(wrong), "a parameter is not a number")
    return points.select("point_id", *[F.col(p).cast("double").alias(p) for p in parameters])


def completed_draws(draws: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Posterior draws of a completed run."""
    refuse_any(runs.where((F.col("run_id") == run) & (F.col("status") != "completed")), "the run is not complete")
    done = runs.where((F.col("run_id") == run) & (F.col("status") == "completed")).select("run_id")
    return draws.where(F.col("run_id") == run).join(done, "run_id", "left_semi")


KEYS = ["chain", "draw"]


def state_at(paths: DataFrame, at: float, tolerance: float = 1e-9) -> DataFrame:
    """The snapshot of every path at a time, within a tolerance; the range filter reaches the scan."""
    return paths.where(F.col("time").between(at - tolerance, at + tolerance))


def terminal_states(paths: DataFrame, columns: list[str]) -> DataFrame:
    last = F.max_by(F.struct("time", *columns), "time").alias("s")
    return paths.groupBy(*KEYS).agg(last).select(*KEYS, "s.*")


def read_final_states(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(chain, draw, time, columns) of stored final states; a column that the file lacks, or two states of one path, are refused."""
    rows = spark.read.parquet(path)
    if lost := [c for c in (*KEYS, "time", *columns) if c not in rows.columns]:
        raise Refused(f"{path} has no column {', '.join(lost)}")
    refuse_any(rows.groupBy(*KEYS).count().where("count > 1"), "a path has two final states")
    return rows.select(*KEYS, "time", *columns)


def snapshot_times(paths: DataFrame, chain: int, draw: int) -> DataFrame:
    return paths.where((F.col("chain") == chain) & (F.col("draw") == draw)).select("time").orderBy("time")


def one_path(paths: DataFrame, chain: int, draw: int) -> DataFrame:
    return paths.where((F.col("chain") == chain) & (F.col("draw") == draw)).orderBy("time")


def joint_draws(draws: DataFrame, paths: DataFrame, keys: tuple[str, ...] = ("chain", "draw")) -> DataFrame:
    """Parameters and path of each draw together."""
    return draws.join(paths, list(keys))


EVENT_LOG = "time double, transition int, multiplicity long, batched boolean, step long, lineage_weights array<double>"
LINE_LIST = "time double, transition long, individual long, source long, destination long, deme long, parent_kind string, parent_id long, parent_deme long, attribution_logprob double"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".tsv"):
        flat = spark.read.csv(path, sep="\t", header=True, schema=EVENT_LOG.replace("array<double>", "string"), nullValue=MISSING)
        weights = F.transform(F.split("lineage_weights", ","), lambda x: x.cast("double"))
        return flat.withColumn("lineage_weights", F.when(F.col("lineage_weights") != "", weights))
    return spark.read.schema(EVENT_LOG).parquet(path)


def stream_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder as a stream, file by file."""
    return spark.readStream.schema(EVENT_LOG).parquet(path)


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """Line list; -1 in an id column is missing."""
    df = spark.read.csv(path, sep="\t", header=True, schema=LINE_LIST, nullValue=MISSING) if path.endswith(".tsv") else spark.read.schema(LINE_LIST).parquet(path)
    return df.withColumns({c: F.when(F.col(c) != -1, F.col(c)) for c in ("individual", "source", "destination", "deme", "parent_id", "parent_deme")})


def read_run_records(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Run records below a catalog root, partitioned by kind; records that can't be read are dropped."""
    df = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", "false").json(root, schema="run_id string, label string, status string, created timestamp, method string, parameters map<string,double>, kind string")
    return df if kind is None else df.where(F.col("kind") == kind)


def read_prequential(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
