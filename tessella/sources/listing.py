"""Folders as relations: names without contents."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources.archives import opened

ENTRIES = "folder string, name string, is_dir boolean, size long, modified timestamp"


class FolderReader(DataSourceReader):
    def __init__(self, paths: list[str], below: bool):
        self.paths, self.below = paths, below

    def partitions(self) -> list[InputPartition]:
        """A task for each folder; with `below` also for each of its subfolders, whose names alone the driver lists."""
        out = []
        for path in self.paths:
            out.append(InputPartition(path))
            if self.below:
                fs, name = opened(path)
                found = fs.get_file_info(pafs.FileSelector(name, allow_not_found=True))
                out += [InputPartition(f"{path.rstrip('/')}/{f.base_name}") for f in sorted(found, key=lambda f: f.base_name) if f.type == pafs.FileType.Directory]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        fs, name = opened(partition.value)
        for f in fs.get_file_info(pafs.FileSelector(name)):
            there = f.type == pafs.FileType.Directory
            yield partition.value, f.base_name, there, None if there else f.size, f.mtime


class FolderEntries(DataSource):
    """Options: path (comma-separated folders), below (true: their subfolders' entries, too)."""

    @classmethod
    def name(cls) -> str:
        return "tessella_listing"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"].split(","), self.options.get("below", "false") == "true")


def read_entries(spark: SparkSession, path: str, below: bool = False) -> DataFrame:
    """A folder's entries: folder, name, is_dir, size, modified and ord, the listing's order, which is that of the names.

    What the planner takes as the finished archives' listing; a folder that is missing fails the read.
    """
    spark.dataSource.register(FolderEntries)
    return spark.read.format("tessella_listing").option("below", str(below).lower()).load(path).withColumn("ord", F.col("name"))
