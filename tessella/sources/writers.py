"""Archives written from tiles: each task writes files of its own, under another name until they are whole."""

from __future__ import annotations

import io
import os
import sqlite3
import tarfile
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.sources.archives import opened

Rows = Iterator[tuple]


def _tar(rows: Rows, out: str) -> None:
    with tarfile.open(out, "w:gz", compresslevel=1) as tar:
        for x, y, data, *name in rows:
            entry = tarfile.TarInfo(name[0] if name else f"tiles/{x}/{y}.png")
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))


def _sqlite(rows: Rows, out: str) -> None:
    with sqlite3.connect(out) as db:
        db.execute("create table tiles(x integer, y integer, data blob, primary key (x, y)) without rowid")
        db.executemany("insert or replace into tiles values (?, ?, ?)", (r[:3] for r in rows))


KINDS: dict[str, Callable[[Rows, str], None]] = {"tar.gz": _tar, "db": _sqlite}


def write_archives(tiles: DataFrame, path: str, kind: str) -> list[str]:
    """Writes x, y and data of tiles as one archive (kind tar.gz or db) for each partition; their paths.

    With a column name, that is the entries' name in a tar.gz.
    """
    write = KINDS[kind]
    fs, folder = opened(path)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        if first is None:
            return
        where, base = opened(path)
        name, own = f"part-{TaskContext.get().partitionId():06d}.{kind}", f"{base}/_{uuid.uuid4().hex}"
        with tempfile.TemporaryDirectory() as local:
            write(_chain(first, rows), f"{local}/a")
            with open(f"{local}/a", "rb") as source, where.open_output_stream(own, compression=None) as out:
                while data := source.read(1 << 20):
                    out.write(data)
        where.move(own, f"{base}/{name}")
        yield pa.record_batch([pa.array([name])], ["name"])

    names = tiles.select("x", "y", "data", *(c for c in tiles.columns if c == "name")).mapInArrow(run, "name string").collect()
    return sorted(os.path.join(path, r.name) for r in names)


def _chain(first: tuple, rows: Rows) -> Rows:
    yield first
    yield from rows


def write_folder(tiles: DataFrame, path: str) -> int:
    """Writes tiles as path/x/y.png; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        n = 0
        for batch in batches:
            for x, y, data in zip(*(c.to_pylist() for c in batch.columns)):
                fs.create_dir(f"{base}/{x}", recursive=True)
                own = f"{base}/{x}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own, compression=None) as out:
                    out.write(data)
                fs.move(own, f"{base}/{x}/{y}.png")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return tiles.select("x", "y", "data").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def write_names(names: DataFrame, path: str) -> int:
    """Writes an empty file for each name (a column), as placeholders of finished archives; how many."""
    fs, folder = opened(path)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where.open_output_stream(f"{base}/{name}").close()
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return names.select("name").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
