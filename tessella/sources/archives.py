"""Tile sources: folders, tar archives and SQLite files of leaf tiles.

A path a/b/X/Y.png gives x = X, y = Y at the leaf zoom; the suffix may be missing. Rows whose path or
content is not a tile are left out, fail the read with mode=FAILFAST, or come as rows of their own with
mode=REJECTS: it adds the columns path (of the entry) and reason (null for tiles). A damaged archive fails the
read, but with REJECTS it gives the tiles before the damage and a row `damaged`.

Conditions on z, x and y reach the archives (see PUSHDOWN): SQLite's where, and a tar's entries before
their content is read.
"""

from __future__ import annotations

import atexit
import os
import re
import sqlite3
import tarfile
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessella.functions.tiles import whole_number
from tessella.model import LEAF_ZOOM, MAX_ENTRY_BYTES

ENTRY = re.compile(r"(?:.*/)?([+-]?\d+)/([+-]?\d+?)(?:\.png)?$")
DDL = "z int, x int, y int, crc32 long, data binary"
REJECTS = DDL + ", path string, reason string"
#: The setting with which Spark hands conditions to sources in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
RANGE_BYTES = 64 << 20


class Wanted:
    """Conditions on z, x and y that a reader sees to itself."""

    def __init__(self):
        self.conditions: list[tuple[str, str, tuple]] = []  # column, comparison, values

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Keeps the filters that it can see to; yields the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("z", "x", "y") and type(f) in COMPARED and isinstance(f.value, int):
                self.conditions.append((name, COMPARED[type(f)], (f.value,)))
            elif name in ("z", "x", "y") and type(f) is In and f.value and all(isinstance(v, int) for v in f.value):
                self.conditions.append((name, "in", tuple(f.value)))
            else:
                yield f

    def has(self, z: int, x: int, y: int) -> bool:
        own = {"z": z, "x": x, "y": y}
        test = {"=": lambda a, b: a == b[0], ">": lambda a, b: a > b[0], ">=": lambda a, b: a >= b[0], "<": lambda a, b: a < b[0], "<=": lambda a, b: a <= b[0], "in": lambda a, b: a in b}
        return all(test[how](own[name], values) for name, how, values in self.conditions)

    def sql(self) -> tuple[str, list[int]]:
        """The conditions on x and y for a where, and their values."""
        own = [c for c in self.conditions if c[0] != "z"]
        text = "".join(f" and {name} in ({', '.join('?' * len(v))})" if how == "in" else f" and {name} {how} ?" for name, how, v in own)
        return text, [x for _, _, v in own for x in v]

    def leaf(self) -> bool:
        """Whether leaf tiles are wanted at all."""
        return all(Wanted._one(c) for c in self.conditions if c[0] == "z")

    @staticmethod
    def _one(condition: tuple[str, str, tuple]) -> bool:
        one = Wanted()
        one.conditions = [condition]
        return one.has(LEAF_ZOOM, 0, 0)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def read_folder(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """A folder's files: x and y come from the path, which Spark reads without the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    x = whole_number(F.element_at(parts, -2))
    y = whole_number(F.regexp_replace(F.element_at(parts, -1), r"\.png$", ""))
    rows = files.select(F.lit(LEAF_ZOOM).alias("z"), x.alias("x"), y.alias("y"), F.crc32("content").alias("crc32"), F.col("content").alias("data"), "path")
    bad = F.col("x").isNull() | F.col("y").isNull()
    if mode == "FAILFAST":
        rows = rows.withColumn("x", F.when(bad, F.raise_error(F.concat(F.lit("not a tile: "), F.col("path")))).otherwise(F.col("x")))
    if mode == "REJECTS":
        tile = lambda c: F.when(~bad, F.col(c)).alias(c)
        return rows.select("z", tile("x"), tile("y"), tile("crc32"), tile("data"), "path", F.when(bad, "name").alias("reason"))
    return rows.where(~bad).select("z", "x", "y", "crc32", "data")


class TarReader(DataSourceReader):
    def __init__(self, paths: list[str], mode: str):
        self.paths, self.mode, self.wanted = paths, mode, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        # Rejects are rows without x and y: conditions on these are Spark's, then.
        return filters if self.mode == "REJECTS" else self.wanted.take(filters)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        try:
            yield from self._entries(path)
        except (tarfile.TarError, EOFError, zlib.error) as e:
            if self.mode != "REJECTS":
                raise
            yield None, None, None, None, None, path, f"damaged: {type(e).__name__}"

    def _entries(self, path: str) -> Iterator[tuple]:
        fs, name = opened(path)
        with fs.open_input_stream(name, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for entry in tar:
                if entry.isdir() or entry.issym() or entry.islnk():
                    continue
                m = ENTRY.fullmatch(entry.name)
                if m and entry.isfile() and entry.size <= MAX_ENTRY_BYTES:
                    x, y = int(m[1]), int(m[2])
                    if self.wanted.has(LEAF_ZOOM, x, y):
                        data = tar.extractfile(entry).read()
                        yield LEAF_ZOOM, x, y, zlib.crc32(data), data, *((entry.name, None) if self.mode == "REJECTS" else ())
                elif self.mode == "FAILFAST":
                    raise ValueError(f"not a tile: {entry.name}")
                elif self.mode == "REJECTS":
                    yield None, None, None, None, None, entry.name, "name" if not m else "kind" if not entry.isfile() else "size"


class TarTiles(DataSource):
    """Options: path (comma-separated archives, a task each), mode."""

    @classmethod
    def name(cls) -> str:
        return "tessella_tar"

    def schema(self) -> str:
        return REJECTS if self.options.get("mode") == "REJECTS" else DDL

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"].split(","), self.options.get("mode", "PERMISSIVE"))


_copies: dict[str, str] = {}


def _forget() -> None:
    for own in _copies.values():
        os.unlink(own)
    _copies.clear()


atexit.register(_forget)


@contextmanager
def local_copy(path: str) -> Iterator[str]:
    """A file's local path. A remote one is copied to the worker's own folder once for all its tasks, until the next file."""
    fs, name = opened(path)
    if isinstance(fs, pafs.LocalFileSystem):
        yield name
        return
    if path not in _copies:
        _forget()
        fd, own = tempfile.mkstemp(suffix=".db")
        with os.fdopen(fd, "wb") as out, fs.open_input_stream(name) as stream:
            while data := stream.read(1 << 20):
                out.write(data)
        _copies[path] = own
    yield _copies[path]


class SqliteReader(DataSourceReader):
    """A task for each file and each RANGE_BYTES of it: the driver asks for sizes only, a task finds its own keys."""

    def __init__(self, paths: list[str], ranges: int | None, mode: str):
        self.paths, self.ranges, self.mode, self.wanted = paths, ranges, mode, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return filters if self.mode == "REJECTS" else self.wanted.take(filters)

    def partitions(self) -> list[InputPartition]:
        if not self.wanted.leaf():
            return []
        out = []
        for path in self.paths:
            fs, name = opened(path)
            n = self.ranges or max(1, -(-fs.get_file_info(name).size // RANGE_BYTES))
            out += [InputPartition((path, i, n)) for i in range(n)]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # there are none
            return
        path, i, n = partition.value
        try:
            with local_copy(path) as name, sqlite3.connect(f"file:{name}?mode=ro", uri=True) as db:
                yield from self._tiles(db, path, i, n)
        except sqlite3.DatabaseError as e:
            if self.mode != "REJECTS":
                raise
            if i == 0:
                yield None, None, None, None, None, path, f"damaged: {type(e).__name__}"

    def _tiles(self, db: sqlite3.Connection, path: str, i: int, n: int) -> Iterator[tuple]:
        leaf = f"z = {LEAF_ZOOM}" if any(c[1] == "z" for c in db.execute("pragma table_info(tiles)")) else "1"
        more, values = self.wanted.sql()
        keys = f"from tiles where {leaf}{more}"
        begin, end = None, None
        if n > 1:  # as many rows for each task, in order of (x, y), so that a dense column is divided, too
            total = db.execute(f"select count(*) {keys}", values).fetchone()[0]
            edge = lambda k: db.execute(f"select x, y {keys} order by x, y limit 1 offset ?", [*values, total * k // n]).fetchone()
            begin, end = (edge(i) if i else None), (edge(i + 1) if i + 1 < n else None)
            if total * i // n >= total * (i + 1) // n:
                return
        if begin:
            keys, values = f"{keys} and (x, y) >= (?, ?)", [*values, *begin]
        if end:
            keys, values = f"{keys} and (x, y) < (?, ?)", [*values, *end]
        for x, y, data in db.execute(f"select x, y, data {keys} order by x, y", values):
            good = isinstance(x, int) and isinstance(y, int) and isinstance(data, bytes)
            if good:
                yield LEAF_ZOOM, x, y, zlib.crc32(data), data, *((f"{x}/{y}", None) if self.mode == "REJECTS" else ())
            elif self.mode == "FAILFAST":
                raise ValueError(f"not a tile: {x}/{y}")
            elif self.mode == "REJECTS":
                yield None, None, None, None, None, f"{x}/{y}", "data" if isinstance(x, int) and isinstance(y, int) else "name"


class SqliteTiles(DataSource):
    """Options: path (comma-separated files), ranges (tasks for each file; by its size if not given), mode. Of a file with zooms, the leaf one."""

    @classmethod
    def name(cls) -> str:
        return "tessella_sqlite"

    def schema(self) -> str:
        return REJECTS if self.options.get("mode") == "REJECTS" else DDL

    def reader(self, schema) -> SqliteReader:
        ranges = self.options.get("ranges")
        return SqliteReader(self.options["path"].split(","), int(ranges) if ranges else None, self.options.get("mode", "PERMISSIVE"))
