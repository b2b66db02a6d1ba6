"""Table functions and functions for SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions import png
from tessella.operators import packed


def decoded(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, colour) of an image's visible pixels; none of a null or unreadable one."""
    try:
        own = png.quantised(bytes(data)) if data is not None else np.zeros((0, 0), np.uint8)
    except Exception:  # noqa: BLE001  an unreadable tile has no pixels
        own = np.zeros((0, 0), np.uint8)
    rows, columns = np.nonzero(own)
    return columns, rows, own[rows, columns]


class TileDecode:
    """tile_decode(data), for a lateral join: the visible pixels of each row's image, by their place in it."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from zip(*(c.tolist() for c in decoded(data)))


class TilePixels:
    """tile_pixels(table(...)) of rows z, x, y, data, side (pixels of a tile's side): all visible pixels, by Arrow batches."""

    def eval(self, tiles: pa.RecordBatch) -> Iterator[pa.Table]:
        names = ("z", "x", "y", "data", "side")
        for z, x, y, data, side in zip(*(tiles.column(c).to_pylist() for c in names)):
            px, py, color = decoded(data)
            yield pa.table({"z": pa.array(np.full(len(px), z, np.int32)), "gx": pa.array(px + x * side, pa.int64()), "gy": pa.array(py + y * side, pa.int64()), "color": pa.array(color.astype(np.int32))})


def register(spark: SparkSession) -> None:
    """Makes tile_decode, tile_pixels, tile_diff, tile_undiff, tile_requantise and tile_readable known to SQL text."""
    spark.udtf.register("tile_decode", F.udtf(TileDecode, returnType="px int, py int, color int", useArrow=True))
    spark.udtf.register("tile_pixels", F.arrow_udtf(TilePixels, returnType="z int, gx long, gy long, color int"))
    for name, make in (("tile_diff", packed.tile_diff_udf), ("tile_undiff", packed.tile_undiff_udf), ("tile_requantise", packed.requantise_udf), ("tile_readable", packed.readable_udf)):
        spark.udf.register(name, make())
