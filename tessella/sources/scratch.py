"""Folders for a job's own files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where that is unset, a temporary one in a local
    session and an error on a cluster, whose executors would not share it."""
    shared = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        shared = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once in a new folder and read again: it is computed once, and later steps start from it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
