"""Tables that cut lineage in iterative plans, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs in one process, as in tests."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        own = tempfile.TemporaryDirectory(prefix="strataflow-core-")
        atexit.register(own.cleanup)
        _own[sc.applicationId] = "file://" + own.name
    return _own[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df``, written and read back: the next round's plan begins with a scan, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/strataflow-core-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
