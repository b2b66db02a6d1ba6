"""Whole jobs: ingest an archive, build its pyramid, look tiles up, run a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.model import LEAF_ZOOM, TOP_MERGE_ZOOM
from tessella.operators.packed import ingest_tiles, merge_level, readable
from tessella.operators.pixels import parents
from tessella.plans.planner import execute
from tessella.sources import read_tiles
from tessella.sources.scratch import written
from tessella.sources.store import TileStore


def ingest(spark: SparkSession, source: str, store: TileStore, version: str, base: str | None = None, rejects: str | None = None) -> dict:
    """Adds an archive's tiles as a version; with a base version, as a delta on it.

    With rejects (a folder), the entries that are no tiles go there as Parquet (path, reason), and entries and images
    are counted in the same scan of the archive: the result has tiles, rejected and bytes. Reasons: name, kind, size,
    data, image (no image that can be decoded), damaged (an archive ends there).
    """
    found: dict = {}
    if rejects is None:
        rows = read_tiles(spark, source)
    else:
        rows, counters = scan(spark, source)
        rows = written(rows, "scan")
        found = counters.get
        rows.where("reason is not null").select("path", "reason").write.mode("overwrite").parquet(rejects)
        rows = rows.where("reason is null").drop("path", "reason")
    store.put(ingest_tiles(rows, store.tiles(version), store.tiles(base) if base else None), version)
    return found


def scan(spark: SparkSession, source: str) -> tuple[DataFrame, Observation]:
    """(an archive's entries z, x, y, crc32, data, path and reason, counters of them): the counters are known once the rows have been written."""
    rows, counters = read_tiles(spark, source, "REJECTS"), Observation()
    bad = F.when(F.col("reason").isNull() & ~readable(F.col("data")), "image").otherwise(F.col("reason"))
    rows = rows.withColumn("reason", bad)
    count = lambda cond: F.count_if(cond)
    return rows.observe(counters, count(F.col("reason").isNull()).alias("tiles"), count(F.col("reason").isNotNull()).alias("rejected"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes")), counters


def build_pyramid(store: TileStore, version: str, base: str | None = None, first: int = TOP_MERGE_ZOOM, force: bool = False) -> None:
    """Merges zooms first to 0; each level is stored before the next one reads it."""
    if not 0 <= first <= TOP_MERGE_ZOOM:
        raise ValueError(f"first zoom must be 0 to {TOP_MERGE_ZOOM}")
    for z in range(first, -1, -1):
        store.put(merge_level(store.tiles(version), z, store.tiles(base) if base else None, force), version)


def update(store: TileStore, tiles: DataFrame, version: str, base: str | None = None, leaf: int = LEAF_ZOOM) -> int:
    """Upserts leaf tiles (z, x, y, crc32, data) and rebuilds only their ancestors; how many of these changed.

    A zoom's parents are made of the tiles that changed below; those whose bytes come out as they were are neither
    written nor followed up.
    """
    tiles = written(tiles, "update")
    store.put(tiles, version)
    touched, n = tiles.select("x", "y").distinct(), 0
    for z in range(leaf - 1, -1, -1):
        made = merge_level(store.tiles(version), z, store.tiles(base) if base else None, only=parents(touched))
        same = store.tiles(version, z).select("x", "y", F.col("crc32").alias("crc32"))
        made = written(made.join(same, ["x", "y", "crc32"], "left_anti").select("z", "x", "y", "crc32", "data"), "update")
        changed = made.count()
        if not changed:
            break
        store.put(made, version)
        touched, n = made.select("x", "y"), n + changed
    return n


def run_plan(spark: SparkSession, jobs: DataFrame, archive_of: dict, store: TileStore) -> int:
    """Ingests and merges the jobs of a plan; archive_of: path by time. How many were still to do.

    A job works on a draft of the store and is published with its name at the end, in one step: readers see whole
    jobs only. A plan that died is run again: jobs that the store has as done are left out, the one it died in
    starts from what was published before it.
    """
    ran = 0

    def run(job: dict) -> None:
        nonlocal ran
        if job["name"] in store.head()["jobs"]:
            return
        version = job["name"].partition("_")[0]
        base = job["base"].partition("_")[0] if job["is_diff"] else None
        draft = store.begin()
        ingest(spark, archive_of[job["dt"]], draft, version, base)
        build_pyramid(draft, version, base)
        draft.publish(job["name"])
        ran += 1

    execute(jobs, run)
    return ran
