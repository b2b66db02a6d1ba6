"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

_libc = ctypes.CDLL(None)
_KEY = "spark.checkpoint.dir"
#: Whether Spark deletes an action's shuffle files at its end; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, tuple[str, str | None]] = WeakKeyDictionary()  # and the table's name


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in a local session and an error on a cluster."""
    found = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: it cuts the lineage. The shuffle files it took are deleted."""
    spark = df.sparkSession
    path = new_path(spark, label)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    with _set(spark, _CLEANUP, "true"):
        out.parquet(path)
    found = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    _paths[found] = path, None
    return found


def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """df, written once in the shared folder in buckets of a column, so that joins on it don't shuffle it."""
    spark = df.sparkSession
    path, name = new_path(spark, label), f"tessella_{uuid.uuid4().hex}"
    with _set(spark, _CLEANUP, "true"):
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    found = spark.table(name)
    _paths[found] = path, name
    return found


def columns_of(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of a table of written(), which discard() then takes for the table."""
    found = df.select(*columns)
    if df in _paths:
        _paths[found] = _paths[df]
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() and bucketed() that no result still to be computed reads."""
    for df in tables:
        spark, (path, name) = df.sparkSession, _paths.pop(df, (None, None))
        if name:
            spark.sql(f"drop table if exists {name}")
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes, so that a worker's memory follows the batch.

    The session keeps these bounds: plans are made when a result is asked for, which may be any time later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= size:
        spark.conf.set(key, f"{size}b")


def release() -> None:
    """Gives memory that a worker has freed back to the system: a worker is kept for the next tasks, whatever they do."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases what it has freed at its end."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For actions on tables of large rows: Arrow batches of so many rows at most, until the block ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _set(spark, key, min(rows, int(spark.conf.get(key)))):
        yield
