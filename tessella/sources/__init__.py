"""Tile sources, chosen by a path's ending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.archives import PUSHDOWN, SqliteTiles, TarTiles, read_folder
from tessella.sources.sevenzip import SevenZipTiles


def read_tiles(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """By the path's ending: .7z, .tar.gz, .tgz, .tar or .db; a directory, whatever its name, or else a folder.

    mode: PERMISSIVE, FAILFAST or REJECTS (see archives; not for .7z). The session then hands conditions to the sources.
    """
    spark.conf.set(PUSHDOWN, "true")
    for kind in (TarTiles, SqliteTiles, SevenZipTiles):
        spark.dataSource.register(kind)
    for endings, name in (((".7z",), "tessella_7z"), ((".tar.gz", ".tgz", ".tar"), "tessella_tar"), ((".db",), "tessella_sqlite")):
        if path.endswith(endings) and not _is_directory(spark, path):
            if mode == "REJECTS" and name == "tessella_7z":
                raise ValueError("7z archives are read without a list of rejects")
            return spark.read.format(name).option("mode", mode).load(path)
    return read_folder(spark, path, mode)


def _is_directory(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()
