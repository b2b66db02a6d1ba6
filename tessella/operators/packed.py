"""Operators on tiles (z, x, y, crc32, data): paletted PNGs, decoded only inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import png
from tessella.functions.tiles import version_sort_key
from tessella.operators.pixels import ingest

KEYS = ["z", "x", "y"]
CHANGE = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("changed", T.BooleanType())])


def majority(a: np.ndarray) -> np.ndarray:
    """Halves an index array: most frequent visible index of each 2x2 block, ties to the first in row order."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    cells = np.stack([a[i:h:2, j:w:2] for i in (0, 1) for j in (0, 1)]).astype(np.int32)
    n = (cells[:, None] == cells[None]).sum(axis=1)
    key = np.where(cells > 0, n * 1024 + (3 - np.arange(4))[:, None, None] * 64 + cells, 0)
    return (key.max(axis=0) % 64).astype(np.uint8)


def difference(base: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, bool]:
    """(new where it differs, else 0; whether anything differs)."""
    changed = base != new
    return np.where(changed, new, 0).astype(np.uint8), bool(changed.any())


def merged(quads: list[np.ndarray | None]) -> np.ndarray | None:
    """Four children (top left, top right, bottom left, bottom right; None: empty) to their parent.

    None if all are empty, or if they differ in size: such a parent fails, and is counted by merge_failures.
    """
    if len({q.shape for q in quads if q is not None}) != 1:
        return None
    shape = next(q.shape for q in quads if q is not None)
    half = [np.zeros((shape[0] // 2, shape[1] // 2), np.uint8) if q is None else majority(q) for q in quads]
    return np.block([[half[0], half[1]], [half[2], half[3]]])


def _opened(data: bytes | None) -> np.ndarray | None:
    """Indices, None for absent or unreadable bytes."""
    try:
        return png.quantised(bytes(data)) if data is not None else None
    except Exception:  # noqa: BLE001  an unreadable tile counts as absent
        return None


def _udf(kind: T.DataType, f: Callable) -> Callable:
    """A pandas UDF of a function of rows' binaries."""
    if isinstance(kind, T.StructType):
        def run(*columns: pd.Series) -> pd.DataFrame:
            rows = [f(*r) for r in zip(*columns)]
            return pd.DataFrame(rows, columns=kind.names)
    else:
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([f(*r) for r in zip(*columns)])
    return F.pandas_udf(run, kind)


def _requantise(data: bytes | None) -> bytes | None:
    own = _opened(data)
    return None if own is None else png.encode(own)


def _diff(base: bytes | None, new: bytes | None) -> tuple[bytes | None, bool]:
    """Without a base of the same size the whole tile stays."""
    a, b = _opened(base), _opened(new)
    if b is None:
        return None, False
    if a is None or a.shape != b.shape:
        return png.encode(b), True
    delta, changed = difference(a, b)
    return png.encode(delta), changed


def _undiff(base: bytes | None, delta: bytes | None) -> bytes | None:
    """Absent or unreadable on either side: none."""
    a, b = _opened(base), _opened(delta)
    return None if a is None or b is None or a.shape != b.shape else png.encode(np.where(b == 0, a, b))


def requantise_udf() -> Callable:
    return _udf(T.BinaryType(), _requantise)


def tile_diff_udf() -> Callable:
    return _udf(CHANGE, _diff)


def tile_undiff_udf() -> Callable:
    return _udf(T.BinaryType(), _undiff)


def readable_udf() -> Callable:
    return _udf(T.BooleanType(), lambda d: _opened(d) is not None)


def requantise(data: Column) -> Column:
    return requantise_udf()(data)


def readable(data: Column) -> Column:
    """Whether an image can be decoded."""
    return readable_udf()(data)


def tile_diff(base: Column, new: Column) -> Column:
    return tile_diff_udf()(base, new)


def tile_undiff(base: Column, delta: Column) -> Column:
    return tile_undiff_udf()(base, delta)


def to_tiles(pixels: DataFrame, z: int, side: int) -> DataFrame:
    """Pixels to tiles: rows come sorted by tile, whose pixels are set in one array; memory holds one tile and a batch."""
    xy = [F.expr(f"cast(g{c} div {side} as int)").alias(c) for c in "xy"]
    rows = pixels.where("color <> 0").select(*xy, F.expr(f"cast(gx % {side} + gy % {side} * {side} as int)").alias("at"), F.col("color").cast("int").alias("color"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own = None, np.zeros(side * side, np.uint8)
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["x", "y", "data"])
            done.clear()
            return out

        for batch in batches:
            x, y, at, color = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(x)]):
                if a == b:
                    continue
                if tile != (x[a], y[a]):
                    if tile:
                        done.append((*tile, png.encode(own.reshape(side, side))))
                    tile = (x[a], y[a])
                    own[:] = 0
                own[at[a:b]] = color[a:b]
            if len(done) > 64:
                yield flush()
        if tile:
            done.append((*tile, png.encode(own.reshape(side, side))))
            yield flush()

    data = rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(draw, "x int, y int, data binary")
    return data.select(F.lit(z).alias("z"), "x", "y", F.crc32("data").alias("crc32"), "data")


def blank_tiles(keys: DataFrame, z: int, side: int) -> DataFrame:
    """Transparent tiles for keys (x, y): what an upsert needs where the last pixel has gone."""
    data = F.lit(bytearray(png.encode(np.zeros((side, side), np.uint8))))
    return keys.select(F.lit(z).alias("z"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.crc32(data).alias("crc32"), data.alias("data"))


def to_pixels(tiles: DataFrame, side: int) -> DataFrame:
    """z, gx, gy, color of all visible pixels; unreadable tiles have none."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = _opened(data)
                if own is not None:
                    rows, columns = np.nonzero(own)
                    yield pa.record_batch([pa.array(np.full(len(rows), z, np.int32)), pa.array(columns + x * side), pa.array(rows + y * side), pa.array(own[rows, columns].astype(np.int32))], ["z", "gx", "gy", "color"])

    return tiles.select(*KEYS, "data").mapInArrow(read, "z int, gx long, gy long, color int")


def ingest_tiles(source: DataFrame, target: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Tiles to store: absent in target, of another checksum than base's, quantised and, with a base, as a delta.

    Keys and checksums decide first; base's images are joined to the remaining rows only. crc32 stays the source's.
    """
    rows = ingest(source, target, base)
    if base is None:
        return rows.withColumn("data", requantise(F.col("data"))).where("data is not null").select(*KEYS, "crc32", "data")
    rows = rows.join(base.select(*KEYS, F.col("data").alias("old")), KEYS, "left").withColumn("d", tile_diff(F.col("old"), F.col("data")))
    return rows.where("d.changed").select(*KEYS, "crc32", F.col("d.data").alias("data"))


def parents_of(tiles: DataFrame) -> DataFrame:
    """Parents (x, y) of tiles (x, y, data): data (null if none can be made) and sizes, how many different ones their children have.

    Children come sorted by parent and place, so that a task holds four images. Of repeated tiles that with the
    least hash is taken; unreadable ones count as absent.
    """
    place = (F.col("x").bitwiseAND(1) + F.col("y").bitwiseAND(1) * 2).cast("int")
    rows = tiles.select(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), place.alias("place"), F.xxhash64("data").alias("h"), "data")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, quads = None, [None] * 4
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32())
            out = pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], ["x", "y", "data", "sizes"])
            done.clear()
            return out

        def close() -> None:
            whole = merged(quads)
            done.append((*parent, None if whole is None else png.encode(whole), len({q.shape for q in quads if q is not None})))

        for batch in batches:
            x, y, place, _, data = batch.columns
            for at, own, here in zip(zip(x.to_pylist(), y.to_pylist()), place.to_pylist(), data):
                if at != parent:
                    if parent:
                        close()
                    parent, quads, seen = at, [None] * 4, set()
                if own not in seen:
                    seen.add(own)
                    quads[own] = _opened(here.as_buffer() if here.is_valid else None)
            if len(done) > 64:
                yield flush()
        if parent:
            close()
            yield flush()

    return rows.repartition("x", "y").sortWithinPartitions("x", "y", "place", "h").mapInArrow(merge, "x int, y int, data binary, sizes int")


def merge_failures(target: DataFrame, z: int) -> DataFrame:
    """Parents at zoom z (x, y) that merge_level leaves out although they have a readable child: those whose children differ in size."""
    return parents_of(target.where(F.col("z") == z + 1).select("x", "y", "data")).where("sizes > 1").select("x", "y")


def merge_level(target: DataFrame, z: int, base: DataFrame | None = None, force: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Parents at zoom z of target's tiles at z + 1; with a base, target holds deltas and so does the result.

    crc32 is of the stored bytes. Parents that target has already are left out unless forced. With only (x, y), these
    parents alone are made, whether target has them or not; a delta that comes to nothing then stays as an empty
    one where target has its tile.
    """
    xy = ["x", "y"]
    children = target.where(F.col("z") == z + 1).select(*xy, "data")
    if only is not None:
        up = {f"__{c}": F.shiftright(c, 1) for c in xy}
        named = only.select(*(F.col(c).alias(f"__{c}") for c in xy)).distinct()
        children = children.withColumns(up).join(named, list(up), "left_semi").select(*xy, "data")
    elif not force:
        had = target.where(F.col("z") == z).select(*(F.col(c).alias(f"__{c}") for c in xy))
        children = children.withColumns({f"__{c}": F.shiftright(c, 1) for c in xy}).join(had, ["__x", "__y"], "left_anti").select(*xy, "data")
    if base is not None:
        old = base.where(F.col("z") == z + 1).select(*xy, F.col("data").alias("old"))
        children = children.join(old, xy).select(*xy, tile_undiff(F.col("old"), F.col("data")).alias("data"))
    rows = parents_of(children).where("data is not null").select(*xy, "data")
    if base is not None:
        old = base.where(F.col("z") == z).select(*xy, F.col("data").alias("old"))
        rows = rows.join(old, xy, "left").withColumn("d", tile_diff(F.col("old"), F.col("data")))
        kept = F.col("d.changed")
        if only is not None:
            rows = rows.join(target.where(F.col("z") == z).select(*xy, F.lit(True).alias("had")), xy, "left")
            kept = kept | F.coalesce("had", F.lit(False))
        rows = rows.where(kept).select(*xy, F.col("d.data").alias("data"))
    return rows.select(F.lit(z).alias("z"), *xy, F.crc32("data").alias("crc32"), "data")


def latest_preview(catalog: DataFrame, tiles: DataFrame, background: bytes | None) -> DataFrame:
    """The map of the latest version's base on a background image: version (the base's), status and data, one row.

    The latest of catalog's versions in their order; its base is the version's part before the dot, whose tile 0/0/0
    of tiles (version, z, x, y, data) is laid over background. status: overlaid; no background or other size (data: the
    tile itself); no tile (data null). An empty catalog gives no row.
    """
    last = catalog.orderBy(*(c.desc() for c in version_sort_key(F.col("version")))).limit(1)
    base = last.select(F.split("version", r"\.")[0].alias("version"))
    rows = base.join(tiles.where("z = 0 and x = 0 and y = 0").select("version", "data"), "version", "left")

    def lay(data: bytes | None) -> tuple[str, bytes | None]:
        top, below = _opened(data), _opened(background)
        if top is None:
            return "no tile", None
        if below is None or below.shape != top.shape:
            return "no background" if below is None else "other size", bytes(data)
        return "overlaid", png.encode(np.where(top == 0, below, top))

    kind = T.StructType([T.StructField("status", T.StringType()), T.StructField("data", T.BinaryType())])
    return rows.select("version", _udf(kind, lay)("data").alias("p")).select("version", "p.status", "p.data")
