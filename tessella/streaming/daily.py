"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.pixels import latest
from tessella.sources.store import TileStore


def pixel_stream(writes: DataFrame, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps each micro-batch's last write of a pixel under path/batch=N; a repeated batch replaces its own folder."""
    def keep(batch: DataFrame, number: int) -> None:
        last = F.max(F.struct(*order, "color"))
        batch.groupBy("gx", "gy").agg(last.alias("w")).select("gx", "gy", "w.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return writes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The map that pixel_stream has gathered."""
    return latest(spark.read.parquet(path), order)


def tile_stream(tiles: DataFrame, store: TileStore, version: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch of tiles."""
    return tiles.writeStream.foreachBatch(lambda batch, _: store.put(batch, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_day(archives: DataFrame, late: str = "1 day") -> DataFrame:
    """One archive of each day (the first to arrive), for a stream with a time column dt."""
    return archives.withWatermark("dt", late).withColumn("day", F.to_date("dt")).dropDuplicatesWithinWatermark(["day"])
