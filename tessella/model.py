"""Schemas, constants and the palette of tiled, versioned pixel maps.

Two forms of one map: *pixels* (gx, gy, color), only visible ones (color 1 to 63), and *tiles*
(z, x, y, crc32, data), a paletted PNG each. With tile side T, gx = x * T + the column in the tile,
so that one zoom step halves gx and gy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_SIDE, LEAF_ZOOM, TOP_MERGE_ZOOM, MAX_ENTRY_BYTES = 1000, 11, 10, 10 << 20
TILES = T.StructType(
    [
        T.StructField("z", T.IntegerType(), False),
        T.StructField("x", T.IntegerType(), False),
        T.StructField("y", T.IntegerType(), False),
        T.StructField("crc32", T.LongType(), True),
        T.StructField("data", T.BinaryType(), False),
    ]
)
PIXELS = "gx long, gy long, color int"

#: RRGGBB of colours 1 to 63 in order; 0 is transparent.
COLORS = """
000000 3C3C3C 787878 D2D2D2 FFFFFF 600018 ED1C24 FF7F27 F6AA09 F9DD3B FFFABC 0EB968 13E67B 87FF5E 0C816E 10AEA6
13E1BE 28509E 4093E4 60F7F2 6B50F6 99B1FB 780C99 AA38B9 E09FF9 CB007A EC1F80 F38DA9 684634 95682A F8B277 AAAAAA
A50E1E FA8072 E45C1A D6B594 9C8431 C5AD31 E8D45F 4A6B3A 5A944A 84C573 0F799F BBFAF2 7DC7FF 4D31B8 4A4284 7A71C4
B5AEF1 DBA463 D18051 FFC5A5 9B5249 D18078 FAB6A4 7B6352 9C846B 333941 6D758D B3B9D1 6D643F 948C6B CDC59E
""".split()


def rgb(index: int) -> tuple[int, int, int]:
    value = int(COLORS[index - 1], 16) if index else 0
    return value >> 16, value >> 8 & 255, value & 255


def palette(spark: SparkSession) -> DataFrame:
    """(idx, r, g, b): 63 rows."""
    return spark.createDataFrame([(i, *rgb(i)) for i in range(1, 64)], "idx int, r int, g int, b int")


def color_channels(color: Column) -> list[Column]:
    """r, g, b, a of a palette index, without a join: 0 is transparent black."""
    table = F.array(*(F.lit(int("FF" + c, 16) if i else 0) for i, c in enumerate(["0", *COLORS])))
    packed = F.get(table, color)
    return [F.shiftright(packed, s).bitwiseAND(255) for s in (16, 8, 0)] + [F.shiftright(packed, 24).bitwiseAND(255)]
