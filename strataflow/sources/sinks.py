"""Writers: trajectories with a manifest, line lists, observation and quantity tables, forecasts, content-addressed leaves."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.checks import Refused

SENTINEL = -1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a small JSON file through Spark's file system: first under another name, then renamed."""
    fs, p = _fs(spark, path + ".tmp")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    target = _fs(spark, path)[1]
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(p, target)


def get_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition:
        w = w.partitionBy(*partition)
    if form == "parquet":
        w.parquet(path)
    elif form in ("tsv", "csv"):
        w.csv(path, sep="\t" if form == "tsv" else ",", header=True, nullValue="NA", emptyValue="")
    else:
        raise ValueError("form must be parquet, tsv or csv")


def write_trajectories(df: DataFrame, path: str, meta: dict, form: str = "parquet", append: bool = False) -> None:
    """Rows keyed (chain, draw, time) and a manifest that lists their columns."""
    manifest = {"columns": df.columns, **meta}
    at = f"{path.rstrip('/')}.manifest.json"
    if append and exists(df.sparkSession, at) and get_json(df.sparkSession, at)["columns"] != df.columns:
        raise Refused("appended rows must have the columns of the manifest")
    write_table(df, path, form, "append" if append else "errorifexists")
    put_json(df.sparkSession, at, manifest)


def write_final_states(df: DataFrame, path: str, columns: list[str]) -> None:
    write_table(df.groupBy("chain", "draw").agg(F.max_by(F.struct("time", *columns), "time").alias("s")).select("chain", "draw", "s.*"), path)


def write_event_log(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Counted events in order of time and step; in text the weights are one field with commas."""
    rows = df.select("time", "transition", "multiplicity", "batched", "step", "lineage_weights")
    if form == "tsv":
        rows = rows.withColumn("lineage_weights", F.array_join("lineage_weights", ","))
    write_table(rows.repartitionByRange("time", "step").sortWithinPartitions("time", "step", "transition"), path, form)


def write_firing_log(firings: DataFrame, path: str, form: str = "tsv") -> None:
    """(name, time, step) of every reactive action that fired, in order of time."""
    write_table(firings.select("name", "time", "step").repartitionByRange("time").sortWithinPartitions("time", "name"), path, form)


def write_pointwise(joint: DataFrame, per_stream: DataFrame, path: str, form: str = "tsv") -> None:
    """Pointwise scores of compared models: one table for the joint score, and one folder per stream, which are never summed."""
    write_table(joint, f"{path}/joint", form)
    write_table(per_stream, f"{path}/streams", form, partition=["stream"])


def write_line_list(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Missing ids become -1 in the file."""
    ids = [c for c in ("individual", "source", "destination", "deme", "parent_id", "parent_deme") if c in df.columns]
    write_table(df.withColumns({c: F.coalesce(c, F.lit(SENTINEL)) for c in ids}), path, form)


def write_streams(df: DataFrame, path: str, stream: str = "stream", form: str = "csv", dims: tuple[str, ...] = (), layout: str = "time", value: str = "value") -> None:
    """Observations, one folder per stream: the time or the window's bounds, the strata, then the value; a hole is ``NA``."""
    if layout not in ("time", "window"):
        raise ValueError("layout must be time or window")
    head = ["time"] if layout == "time" else ["window_start", "window_stop"]
    write_table(df.select(stream, *head, *dims, value), path, form, partition=[stream])


def stacked_quantities(tables: dict[str, DataFrame], group: str = "group") -> DataFrame:
    """Quantity tables of several groups under one another; columns that a group lacks are missing there."""
    import functools

    rows = [df.withColumn(group, F.lit(name)) for name, df in tables.items()]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return out.select(group, *[c for c in out.columns if c != group])


def quantity_table(df: DataFrame, dims: list[str], coords: list[str], time: str | None, banded: bool, convergence: bool = False, censored: bool = False, design: DataFrame | None = None) -> DataFrame:
    """Columns in the order that depends on the table's shape alone.

    ``design``: points (point_id, parameters) of a sweep; a table with ``point_id`` gets the parameters as ``sweep:`` columns.
    """
    head = [*coords, *([time] if time else []), *dims]
    if design is not None:
        names = [c for c in design.columns if c != "point_id"]
        df = df.join(design.select("point_id", *[F.col(c).alias(f"sweep:{c}") for c in names]), "point_id")
        head = [*coords, *[f"sweep:{c}" for c in names], *([time] if time else []), *dims]
        df = df.select(*[F.col(f"`{c}`") for c in df.columns])
    head = [f"`{c}`" for c in head]
    if not banded:
        return df.select(*head, "value")
    middle = ["n_draws", *(["rhat", "ess"] if convergence else []), *(["n_value", "n_censored", "p_censored"] if censored else [])]
    return df.select(*head, *middle, "q05", "q25", "q50", "q75", "q95")


def write_prequential(joint: DataFrame, per_stream: DataFrame, stem: str) -> None:
    write_table(joint.select("t", "log_score", "ess"), f"{stem}.joint")
    write_table(per_stream, f"{stem}.streams", partition=["stream"])


def write_forecast(bands: DataFrame, samples: DataFrame, path: str, meta: dict) -> None:
    write_table(bands, f"{path}/bands")
    write_table(samples, f"{path}/samples")
    put_json(bands.sparkSession, f"{path}/manifest.json", {"bands": bands.columns, "samples": samples.columns, **meta})


def content_id(inputs: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def leaf_state(spark: SparkSession, leaf: str) -> str:
    """``sealed``, ``claimed`` (a writer is at work, or died) or ``free``."""
    return "sealed" if exists(spark, f"{leaf}/sealed.json") else "claimed" if exists(spark, f"{leaf}/claim") else "free"


def content_leaf(spark: SparkSession, root: str, kind: str, inputs: object, make: Callable[[], DataFrame], take_over: bool = False) -> DataFrame:
    """The result for the inputs: read if a sealed leaf has it, else claimed, made, written and sealed.

    Of two writers the one that creates the claim goes on, the other is refused.  A failed run gives its claim up; that of one
    which died stays, until a writer takes it over.
    """
    leaf = f"{root.rstrip('/')}/kind={kind}/{content_id(inputs)}"
    if leaf_state(spark, leaf) != "sealed":
        fs, claim = _fs(spark, f"{leaf}/claim")
        if not fs.createNewFile(claim) and not take_over:
            raise Refused(f"another run is making {leaf}")
        try:
            write_table(make(), f"{leaf}/data", mode="overwrite")
            put_json(spark, f"{leaf}/sealed.json", {"inputs": json.dumps(inputs, sort_keys=True), "kind": kind, "leaf": content_id(inputs)})
        finally:
            fs.delete(claim, False)
    return spark.read.parquet(f"{leaf}/data")


def leaf_index(spark: SparkSession, root: str) -> DataFrame:
    """(kind, leaf, inputs) of every sealed leaf, read from the seals themselves, so that it can't be out of date."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "sealed.json").json(root, schema="kind string, leaf string, inputs string")
