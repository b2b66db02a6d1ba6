"""A tile store: Parquet partitioned by commit, version, zoom and area, keyed by (version, z, x, y).

An area is 64 x 64 tiles of a zoom (1,024 areas at the leaf zoom), so that an upsert rewrites those with new tiles
only and a lookup reads one.

    data/commit=C/version=V/z=Z/area=A/     an area as one commit wrote it; never changed
    manifests/M/                            version, z, area, commit: which commit's copy of an area counts
    heads/N.json                            snapshot N: its manifest, its commits, the jobs that are done

A write adds a commit and a manifest, which no reader sees, and is published by the rename of one file, the next head.
So readers see all of an upsert (or of a draft: several of them) or nothing, and a writer that dies leaves nothing
but files that no head names; `vacuum` deletes those. One writer at a time: a second one's rename fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.tiles import tile_key, version_sort_key
from tessella.operators.pixels import upsert
from tessella.sources.scratch import delete

KEYS = ["version", "z", "x", "y"]
PLACE = ["version", "z", "area"]
ROW = "x int, y int, crc32 long, data binary, version string, z int, area int"
DDL = ROW + ", commit string"
MANIFEST = "version string, z int, area int, commit string"
AREA = 6  # bits of x and y within an area
#: Areas of a manifest (some 60 bytes each) that are broadcast to the readers of the tiles.
BROADCAST_AREAS = 200_000


def area(x: Column, y: Column) -> Column:
    return F.shiftright(y, AREA) * (1 << 16) + F.shiftright(x, AREA)


class TileStore:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self._draft: dict | None = None

    # --- snapshots ---

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        fs, folder = self._files(), self._at("heads")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def head(self, number: int | None = None) -> dict:
        """A snapshot (by default this draft's or the last one): number, manifest, commits, areas and jobs."""
        if number is None and self._draft is not None:
            return self._draft
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "manifest": None, "commits": [], "areas": 0, "jobs": []}
        stream = self._files().open(self._at(f"heads/{(number or numbers[-1]):012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def begin(self) -> TileStore:
        """A draft: the store as it is now, whose upserts only it sees until it is published."""
        out = TileStore(self.spark, self.path, self.read_only)
        out._draft = self.head()
        return out

    def publish(self, job: str | None = None) -> None:
        """Makes a draft's upserts the next snapshot, in one step; with a job, that is marked as done in the same step."""
        new = self._draft | {"number": self._draft["number"] + 1, "jobs": self._draft["jobs"] + ([job] if job else [])}
        self._add(new)
        self._draft = new

    def _add(self, head: dict) -> None:
        fs, name, own = self._files(), self._at(f"heads/{head['number']:012d}.json"), self._at(f"heads/.{uuid.uuid4().hex}")
        fs.mkdirs(self._at("heads"))
        out = fs.create(own)
        try:
            out.write(bytearray(json.dumps(head).encode()))
        finally:
            out.close()
        if fs.exists(name) or not fs.rename(own, name):
            fs.delete(own, False)
            raise RuntimeError(f"snapshot {head['number']} is there already: another writer was faster")

    def manifest(self, head: dict | None = None) -> DataFrame:
        """version, z, area and the commit whose copy of it counts."""
        head = head or self.head()
        if head["manifest"] is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{head['manifest']}")

    def _rows(self) -> DataFrame:
        head = self.head()
        if not head["commits"]:
            return self.spark.createDataFrame([], ROW)
        folders = [f"{self.path}/data/commit={c}" for c in head["commits"]]
        rows = self.spark.read.schema(DDL).option("basePath", f"{self.path}/data").parquet(*folders)
        if len(folders) > 1:
            known = self.manifest(head)
            known = F.broadcast(known) if head["areas"] <= BROADCAST_AREAS else known
            rows = rows.join(known, [*PLACE, "commit"], "left_semi")
        return rows.drop("commit")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` snapshots and the files that none of these has; how many commits went."""
        fs, numbers = self._files(), self._numbers()
        heads = [self.head(n) for n in numbers[-keep:]]
        commits, manifests = {c for h in heads for c in h["commits"]}, {h["manifest"] for h in heads}
        for n in numbers[:-keep]:
            fs.delete(self._at(f"heads/{n:012d}.json"), False)
        gone = 0
        for folder, known in (("data", {f"commit={c}" for c in commits}), ("manifests", manifests)):
            for f in fs.listStatus(self._at(folder)) if fs.exists(self._at(folder)) else []:
                if f.getPath().getName() not in known:
                    fs.delete(f.getPath(), True)
                    gone += folder == "data"
        return gone

    # --- tiles ---

    def tiles(self, version: str | None = None, z: int | None = None) -> DataFrame:
        """Rows of a version and zoom: only their partitions are read."""
        rows = self._rows().drop("area")
        rows = rows if version is None else rows.where(F.col("version") == version)
        return rows if z is None else rows.where(F.col("z") == z)

    def _tile(self, version: str, z: int, x: int, y: int) -> DataFrame:
        own = (y >> AREA) * (1 << 16) + (x >> AREA)
        return self._rows().where((F.col("version") == version) & (F.col("z") == z) & (F.col("area") == own) & (F.col("x") == x) & (F.col("y") == y))

    def get(self, version: str, z: int, x: int, y: int) -> DataFrame:
        return self._tile(version, z, x, y).select("data")

    def stat(self, version: str, z: int, x: int, y: int) -> DataFrame:
        """crc32 of the tile, no row without one; the image isn't read."""
        return self._tile(version, z, x, y).select("crc32")

    def status(self, version: str, z: int, x: int, y: int) -> DataFrame:
        """One row: exists, crc32 and error ("checksum" for a tile without one, else null)."""
        found = self.stat(version, z, x, y).agg(F.count(F.lit(1)).alias("n"), F.max("crc32").alias("crc32"))
        return found.select((F.col("n") > 0).alias("exists"), "crc32", F.when((F.col("n") > 0) & F.col("crc32").isNull(), "checksum").alias("error"))

    def addresses(self, version: str, z: int) -> DataFrame:
        return self.tiles(version, z).select("x", "y")

    def catalog(self) -> DataFrame:
        """Versions in order with their number of tiles."""
        return self.tiles().groupBy("version").agg(F.count(F.lit(1)).alias("tiles")).orderBy(*version_sort_key(F.col("version")))

    def put(self, tiles: DataFrame, version: str, auto_crc: bool = False) -> None:
        """Upserts tiles (z, x, y, crc32, data), in one step for readers. They are computed once, into a staged copy; only
        areas with new rows are written anew. Of several rows of a tile that with the least checksum is taken."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        rows = tiles.withColumns({"version": F.lit(version), "area": area(F.col("x"), F.col("y"))})
        rows = rows.withColumn("crc32", F.crc32("data")) if auto_crc else rows
        staged, commit, head = f"{self.path}/staged-{uuid.uuid4().hex}", uuid.uuid4().hex, self.head()
        rows.select("x", "y", "crc32", "data", *PLACE).write.parquet(staged)
        rows = self.spark.read.schema(ROW).parquet(staged)
        touched = rows.select(*PLACE).distinct()
        known = self.manifest(head)
        after = known.join(touched, PLACE, "left_anti").unionByName(touched.withColumn("commit", F.lit(commit)))
        name = uuid.uuid4().hex
        after.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        made = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")
        counts = {r.commit: r.n for r in made.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).collect()}  # the areas' number at most
        if commit in counts:
            old = self._rows().where(F.col("version") == version).join(touched, PLACE, "left_semi")
            new = upsert(old, rows, KEYS, [F.col("crc32"), F.xxhash64("data")])
            new.repartition(*PLACE).write.partitionBy(*PLACE).parquet(f"{self.path}/data/commit={commit}")
            after = head | {"manifest": name, "commits": sorted(counts), "areas": sum(counts.values())}
            if self._draft is None:
                self._add(after | {"number": head["number"] + 1})
            else:
                self._draft = after
        delete(self.spark, staged)

    def set_crc(self, checksums: DataFrame, version: str) -> None:
        """Replaces crc32 of the tiles in checksums (z, x, y, crc32)."""
        new = self.tiles(version).drop("crc32").join(checksums, ["z", "x", "y"])
        self.put(new.select("z", "x", "y", "crc32", "data"), version)

    def keys(self) -> DataFrame:
        return self.tiles().select(*KEYS, tile_key(F.col("z"), F.col("x"), F.col("y")).alias("key"))
