"""The driver's queries over the given tables, and their SQL.

Pixels come from lineitem (a 512 x 512 map, written in order of l_shipdate; the base map is what was
there before BASE_DAY), archives and requests from events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import png, udtf
from tessella.functions import tiles as tf
from tessella.model import COLORS, LEAF_ZOOM, color_channels
from tessella.operators import packed
from tessella.operators import pixels as px
from tessella.plans import planner
from tessella import api
from tessella.sources import read_tiles, writers
from tessella.sources.listing import read_entries
from tessella.sources.scratch import scratch, written
from tessella.sources.store import TileStore
from tessella.streaming import daily, rates

SIDE, LEAF = 8, 6  # tiles of 8 x 8 pixels: 64 x 64 tiles at zoom 6
BASE_DAY = "1995-06-01"
LATE_DAY = "1998-06-01"  # a fourteenth of the writes come later
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]
EPOCH = "2024-01-01"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_writes(lineitem: DataFrame) -> DataFrame:
    gx = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 512
    gy = (F.col("l_orderkey") * 13 + F.col("l_suppkey")) % 512
    color = (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 64
    return lineitem.select(gx.cast("long").alias("gx"), gy.cast("long").alias("gy"), color.cast("int").alias("color"), *ORDER)


def writes(spark: SparkSession, sf: str) -> DataFrame:
    return as_writes(table(spark, sf, "lineitem"))


def state(spark: SparkSession, sf: str, before: str | None = None) -> DataFrame:
    own = writes(spark, sf)
    return px.latest(own.where(F.col("l_shipdate") < before) if before else own, ORDER).where("color <> 0")


def old(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf, BASE_DAY)


def checked(pixels: DataFrame) -> DataFrame:
    """Tiles at the leaf zoom with a checksum of their pixels in place of a stored image's."""
    sums = F.sum(F.col("color") * (F.col("gx") * 31 + F.col("gy") * 17 + 1)).alias("crc32")
    return px.tile_of(pixels, SIDE).groupBy("x", "y").agg(sums).select(F.lit(LEAF).alias("z"), "x", "y", "crc32")


# --- SQL building blocks -------------------------------------------------------------------------

LI = """li AS (SELECT CAST((l_partkey * 7 + l_linenumber) % 512 AS BIGINT) AS gx, CAST((l_orderkey * 13 + l_suppkey) % 512 AS BIGINT) AS gy,
 CAST((l_orderkey * 31 + l_linenumber) % 64 AS INTEGER) AS color, l_shipdate, l_orderkey, l_linenumber FROM lineitem)"""


def _state_sql(name: str, before: str | None = None) -> str:
    cond = f"WHERE l_shipdate < TIMESTAMP '{before}'" if before else ""
    return f"""{name} AS (SELECT gx, gy, color FROM (SELECT gx, gy, color, row_number() OVER (PARTITION BY gx, gy
 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, color DESC) AS rn FROM li {cond}) WHERE rn = 1 AND color <> 0)"""


NEW, OLD = f"WITH {LI},\n{_state_sql('new')}", f"WITH {LI},\n{_state_sql('new')},\n{_state_sql('old', BASE_DAY)}"
BOTH = """c AS (SELECT coalesce(o.gx, n.gx) AS gx, coalesce(o.gy, n.gy) AS gy, coalesce(o.color, 0) AS b, coalesce(n.color, 0) AS n
 FROM old o FULL OUTER JOIN new n ON o.gx = n.gx AND o.gy = n.gy)"""
DELTA = "delta AS (SELECT gx, gy, n AS color FROM c WHERE b <> n AND n <> 0)"


def _majority(source: str) -> str:
    return f"""SELECT gx, gy, color FROM (SELECT x AS gx, y AS gy, color, row_number() OVER (PARTITION BY x, y ORDER BY count(*) DESC, min(p)) AS rn
 FROM (SELECT gx // 2 AS x, gy // 2 AS y, gx % 2 + 2 * (gy % 2) AS p, color FROM {source}) GROUP BY x, y, color) WHERE rn = 1"""


def _cells(block: int, source: str = "new") -> str:
    """Every pixel of the blocks that have a visible one."""
    return f"""cells AS (SELECT b.x, b.y, p.p, coalesce(s.color, 0) AS color FROM (SELECT DISTINCT gx // {block} AS x, gy // {block} AS y FROM {source}) b
 CROSS JOIN (SELECT unnest(range({block * block})) AS p) p LEFT JOIN {source} s ON s.gx = b.x * {block} + p.p % {block} AND s.gy = b.y * {block} + p.p // {block})"""


def _ranked(block: int, order: str) -> str:
    return f"""{NEW},\n{_cells(block)}
SELECT x AS gx, y AS gy, color FROM (SELECT x, y, color, row_number() OVER (PARTITION BY x, y ORDER BY {order}) AS rn FROM cells GROUP BY x, y, color) WHERE rn = 1 AND color <> 0"""


XY = f"CAST(gx // {SIDE} AS INTEGER) AS x, CAST(gy // {SIDE} AS INTEGER) AS y"

# --- pixels: state, tiles, differences -----------------------------------------------------------


@query(f"{NEW} SELECT gx, gy, color FROM new")
def pixel_state_lww(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf)


@query(f"{NEW}, t AS (SELECT DISTINCT {XY} FROM new) SELECT CAST({LEAF} AS INTEGER) AS z, x, y FROM t")
def tile_list_by_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return px.tiles(state(spark, sf), SIDE).select(F.lit(LEAF).alias("z"), "x", "y")


@query(f"{NEW} SELECT x, y, count(*) AS pixels, count(DISTINCT color) AS colors FROM (SELECT {XY}, color FROM new) GROUP BY x, y")
def tile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return px.tiles(state(spark, sf), SIDE)


@query(f"{NEW} SELECT '{LEAF}/' || x || '/' || y AS key, '\"v1-{LEAF}/' || x || '/' || y || '\"' AS etag FROM (SELECT DISTINCT {XY} FROM new)")
def tile_key_etag(spark: SparkSession, sf: str) -> DataFrame:
    z = F.lit(LEAF)
    return px.tiles(state(spark, sf), SIDE).select(tf.tile_key(z, F.col("x"), F.col("y")).alias("key"), tf.etag(F.lit("v1"), z, F.col("x"), F.col("y")).alias("etag"))


@query(f"{NEW} SELECT DISTINCT CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y FROM (SELECT {XY} FROM new)")
def parents_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return px.parents(px.tiles(state(spark, sf), SIDE))


@query(f"{NEW} SELECT x, y, CAST(4 - count(*) AS BIGINT) AS empty_children FROM (SELECT DISTINCT CAST(gx // 16 AS INTEGER) AS x, CAST(gy // 16 AS INTEGER) AS y, gx // 8 AS cx, gy // 8 AS cy FROM new) GROUP BY x, y")
def empty_tile_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with a visible child, and how many of their four are empty."""
    own = px.tiles(state(spark, sf), SIDE)
    return own.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg((4 - F.count(F.lit(1))).alias("empty_children"))


@query(f"{OLD}, {BOTH} SELECT gx, gy, n AS color FROM c WHERE b <> n AND n <> 0")
def diff_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return px.diff(old(spark, sf), state(spark, sf))


@query(f"{OLD}, {BOTH} SELECT gx, gy, n AS color, n = 0 AS erased FROM c WHERE b <> n")
def diff_exact(spark: SparkSession, sf: str) -> DataFrame:
    return px.diff(old(spark, sf), state(spark, sf), exact=True)


@query(f"{OLD}, {BOTH} SELECT x, y, count(*) AS changed, count(*) FILTER (n = 0) AS erased FROM (SELECT {XY}, n FROM c WHERE b <> n) GROUP BY x, y")
def diff_changed_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return px.changed_tiles(old(spark, sf), state(spark, sf), SIDE)


@query(f"{OLD}, {BOTH} SELECT gx, gy, CASE WHEN n <> 0 THEN n ELSE b END AS color FROM c")
def undiff_resolve(spark: SparkSession, sf: str) -> DataFrame:
    base = old(spark, sf)
    return px.undiff(base, px.diff(base, state(spark, sf)))


@query(f"{NEW} SELECT gx, gy, color FROM new")
def undiff_exact(spark: SparkSession, sf: str) -> DataFrame:
    base = old(spark, sf)
    return px.exact_undiff(base, px.diff(base, state(spark, sf), exact=True))


@query(f"{OLD}, {BOTH} SELECT gx, gy, b AS color FROM c WHERE n = 0")
def lost_erasures(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels that undiff brings back although the new map has none there."""
    return px.compared(old(spark, sf), state(spark, sf)).where("n = 0").select("gx", "gy", F.col("b").alias("color"))


@query(f"{OLD}, {BOTH} SELECT gx, gy, CASE WHEN n <> 0 THEN n ELSE b END AS color FROM c")
def preview_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return px.overlay(old(spark, sf), state(spark, sf))


_RGB = ", ".join(f"({i}, {int(c[:2], 16)}, {int(c[2:4], 16)}, {int(c[4:], 16)})" for i, c in enumerate(COLORS, 1))


def _source_colors(pixels: DataFrame) -> DataFrame:
    """RGBA pixels: the palette's colours, some shifted off it, some half transparent."""
    r, g, b, _ = color_channels(F.col("color"))
    alpha = F.when(F.col("gx") % 7 == 0, 0).when(F.col("gx") % 7 == 1, 1).otherwise(255)
    return pixels.select("gx", "gy", (r + (F.col("gy") % 11 == 0).cast("int")).alias("r"), g.alias("g"), b.alias("b"), alias_int(alpha, "a"))


def alias_int(c: Column, name: str) -> Column:
    return c.cast("int").alias(name)


@query(f"""{NEW}, p(idx, r, g, b) AS (VALUES {_RGB}),
s AS (SELECT gx, gy, r + CASE WHEN gy % 11 = 0 THEN 1 ELSE 0 END AS r, g, b, CASE WHEN gx % 7 = 0 THEN 0 WHEN gx % 7 = 1 THEN 1 ELSE 255 END AS a FROM new JOIN p ON idx = color),
m AS (SELECT gx, gy, a, (r * 257 * a // 255) // 256 AS r, (g * 257 * a // 255) // 256 AS g, (b * 257 * a // 255) // 256 AS b FROM s)
SELECT gx, gy, CAST(CASE WHEN a = 0 THEN 0 ELSE coalesce(idx, 0) END AS INTEGER) AS color FROM m LEFT JOIN p USING (r, g, b)""")
def palette_quantise(spark: SparkSession, sf: str) -> DataFrame:
    return px.quantise(_source_colors(state(spark, sf)))


# --- zoom steps ----------------------------------------------------------------------------------


@query(f"{NEW} {_majority('new')}")
def downsample_majority(spark: SparkSession, sf: str) -> DataFrame:
    return px.downsample(state(spark, sf))


@query(_ranked(2, "count(*) DESC, min(p)"))
def downsample_mode_all(spark: SparkSession, sf: str) -> DataFrame:
    return px.downsample(state(spark, sf), "mode")


@query(_ranked(2, "sum(CASE WHEN color = 0 THEN 1 ELSE 2 END) DESC, max(p)"))
def downsample_weighted2(spark: SparkSession, sf: str) -> DataFrame:
    return px.downsample(state(spark, sf), "weighted")


@query(_ranked(4, "sum(CASE WHEN color = 0 THEN 1 ELSE 4 END) DESC, max(p)"))
def downsample_weighted4(spark: SparkSession, sf: str) -> DataFrame:
    return px.block_mode(state(spark, sf), 4)


@query(_ranked(16, "sum(CASE WHEN color = 0 THEN 1 ELSE 16 END) DESC, max(p)"))
def downsample_weighted16(spark: SparkSession, sf: str) -> DataFrame:
    return px.block_mode(state(spark, sf), 16)


@query(f"""{NEW}, p(idx, r, g, b) AS (VALUES {_RGB}),
{_cells(2)}
SELECT x AS gx, y AS gy, {', '.join(f"CAST((sum(coalesce({c}, 0) * 257) // 4) // 256 AS INTEGER) AS {c}" for c in 'rgb')}, CAST((count(idx) * 65535 // 4) // 256 AS INTEGER) AS a
FROM cells LEFT JOIN p ON idx = color GROUP BY x, y""")
def downsample_avg(spark: SparkSession, sf: str) -> DataFrame:
    return px.average(state(spark, sf))


@query(f"""WITH avg AS ({ORACLE_SQL['downsample_avg']}), {NEW[5:]}, f AS (SELECT CAST(gx // 16 AS INTEGER) AS x, CAST(gy // 16 AS INTEGER) AS y FROM new GROUP BY gx // 16, gy // 16 HAVING count(DISTINCT (gx // 8) * 1000 + gy // 8) = 4)
SELECT avg.* FROM avg SEMI JOIN f ON f.x = avg.gx // {SIDE} AND f.y = avg.gy // {SIDE}""")
def average_complete_tiles(spark: SparkSession, sf: str) -> DataFrame:
    own = state(spark, sf)
    return px.average_tiles(own, px.tiles(own, SIDE), SIDE)


@query(f"""{NEW}, l6 AS (SELECT gx, gy, color FROM new), {', '.join(f"l{z} AS ({_majority(f'l{z + 1}')})" for z in range(5, -1, -1))}
{' UNION ALL '.join(f"SELECT CAST({z} AS INTEGER) AS z, gx, gy, color FROM l{z}" for z in range(6))}""")
def pyramid_all_levels(spark: SparkSession, sf: str) -> DataFrame:
    return px.pyramid(state(spark, sf), LEAF, side=SIDE, keep=lambda df: written(df, "level"))


def _diff_step(z: int) -> str:
    """Level z from level z + 1 (suffix 'c' for child): d, dt: delta pixels and tiles; b, bt: base."""
    c = z + 1
    t = lambda s: f"SELECT DISTINCT {XY} FROM {s}"
    return f"""b{z} AS ({_majority(f'b{c}')}), bt{z} AS ({t(f'b{z}')}),
k{z} AS (SELECT x, y FROM dt{c} INTERSECT SELECT x, y FROM bt{c}),
u{z} AS (SELECT coalesce(d.gx, b.gx) AS gx, coalesce(d.gy, b.gy) AS gy, coalesce(d.color, b.color) AS color FROM d{c} d FULL OUTER JOIN b{c} b ON d.gx = b.gx AND d.gy = b.gy),
v{z} AS (SELECT gx, gy, color FROM u{z} SEMI JOIN k{z} ON k{z}.x = gx // {SIDE} AND k{z}.y = gy // {SIDE}),
m{z} AS ({_majority(f'v{z}')}), p{z} AS (SELECT DISTINCT CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y FROM k{z}),
w{z} AS (SELECT coalesce(m.gx, b.gx) AS gx, coalesce(m.gy, b.gy) AS gy, coalesce(m.color, 0) AS n, coalesce(b.color, 0) AS b FROM m{z} m FULL OUTER JOIN b{z} b ON m.gx = b.gx AND m.gy = b.gy),
x{z} AS (SELECT w.gx, w.gy, w.n, w.b, p.x, p.y, t.x IS NOT NULL AS has FROM w{z} w JOIN p{z} p ON p.x = w.gx // {SIDE} AND p.y = w.gy // {SIDE} LEFT JOIN bt{z} t ON t.x = p.x AND t.y = p.y),
d{z} AS (SELECT gx, gy, n AS color FROM x{z} WHERE n <> 0 AND (NOT has OR b <> n)),
dt{z} AS (SELECT DISTINCT x, y FROM x{z} WHERE has AND b <> n UNION SELECT x, y FROM p{z} ANTI JOIN bt{z} USING (x, y))"""


_DIFF_LEVELS = f"""{OLD}, {BOTH}, d6 AS (SELECT gx, gy, n AS color FROM c WHERE b <> n AND n <> 0), dt6 AS (SELECT DISTINCT {XY} FROM c WHERE b <> n),
b6 AS (SELECT gx, gy, color FROM old), bt6 AS (SELECT DISTINCT {XY} FROM old), {{steps}}
{{select}}"""


def _diff_sql(*zooms: int) -> str:
    select = " UNION ALL ".join(f"SELECT CAST({z} AS INTEGER) AS z, gx, gy, color FROM d{z}" for z in zooms)
    return _DIFF_LEVELS.format(steps=", ".join(_diff_step(z) for z in zooms), select=select)


@query(_diff_sql(5, 4))
def pyramid_diff_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Two zoom steps of a delta map on its base, by the operator of one step."""
    base, new = old(spark, sf), state(spark, sf)
    delta, changed, out = px.diff(base, new), px.changed_tiles(base, new, SIDE).select("x", "y"), []
    for z in (5, 4):
        above = written(px.downsample(base), "base")
        delta, changed = px.diff_level(delta, changed, base, px.tiles(base, SIDE), above, px.tiles(above, SIDE), SIDE)
        delta, changed, base = written(delta, "delta"), written(changed, "changed"), above
        out.append(delta.select(F.lit(z).alias("z"), "gx", "gy", "color"))
    return out[0].unionAll(out[1])


@query(_diff_sql(5, 4, 3, 2, 1, 0))
def pyramid_diff_levels(spark: SparkSession, sf: str) -> DataFrame:
    """All zoom steps of a delta map on its base."""
    return px.diff_pyramid(old(spark, sf), state(spark, sf), LEAF, SIDE, lambda df: written(df, "delta"))


def late_update(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(map before LATE_DAY, its pyramid, map after it, leaf tiles that differ), written."""
    keep = lambda df: written(df, "late")
    base, new = keep(state(spark, sf, LATE_DAY)), keep(state(spark, sf))
    return base, px.pyramid(base, LEAF, side=SIDE, keep=keep), new, keep(px.changed_tiles(base, new, SIDE))


@query(ORACLE_SQL["pyramid_all_levels"])
def pyramid_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """The pyramid of the map before the last writes, brought up to date: only ancestors of changed tiles are rebuilt."""
    _, levels, new, touched = late_update(spark, sf)
    pixels, tiles = px.refreshed(new, touched, levels, LEAF, SIDE, lambda df: written(df, "refreshed"))
    return px.patched(levels, pixels, tiles, SIDE)


_LATE = f"WITH {LI},\n{_state_sql('new')},\n{_state_sql('old', LATE_DAY)}"


@query(_diff_sql(5, 4, 3, 2, 1, 0).replace(OLD, _LATE))
def pyramid_delta_levels(spark: SparkSession, sf: str) -> DataFrame:
    """All zoom steps of the delta of the last writes, on a base with a stored pyramid."""
    base, levels, new, touched = late_update(spark, sf)
    return px.delta_levels(base, px.diff(base, new), touched, levels, LEAF, SIDE, lambda df: written(df, "delta"))


@query(ORACLE_SQL["pyramid_all_levels"])
def packed_update(spark: SparkSession, sf: str) -> DataFrame:
    """A store of PNG tiles and its pyramid, upserted with the tiles of the last writes: zooms below the leaf's, as pixels."""
    base, _, new, touched = late_update(spark, sf)
    store = TileStore(spark, scratch(spark, "store"))
    store.put(packed.to_tiles(base, LEAF, SIDE), "v1")
    for z in range(LEAF - 1, -1, -1):
        store.put(packed.merge_level(store.tiles("v1"), z), "v1")
    changed = written(packed.to_tiles(px.tile_of(new, SIDE).join(touched.select("x", "y"), ["x", "y"], "left_semi"), LEAF, SIDE), "changed")
    gone = touched.join(changed, ["x", "y"], "left_anti")
    api.update(store, changed.unionByName(packed.blank_tiles(gone, LEAF, SIDE)), "v1", leaf=LEAF)
    return packed.to_pixels(store.tiles("v1").where(F.col("z") < LEAF), SIDE)


@query(f"{OLD} SELECT DISTINCT CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y FROM (SELECT {XY} FROM new) EXCEPT SELECT DISTINCT CAST(gx // 16 AS INTEGER), CAST(gy // 16 AS INTEGER) FROM old WHERE gx < 256")
def merge_skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Parents that a store doesn't have yet."""
    stored = px.parents(px.tiles(old(spark, sf).where("gx < 256"), SIDE))
    return px.parents(px.tiles(state(spark, sf), SIDE)).join(stored, ["x", "y"], "left_anti")


# --- ingest --------------------------------------------------------------------------------------

_TILES = f"SELECT CAST({LEAF} AS INTEGER) AS z, x, y, CAST(sum(color * (gx * 31 + gy * 17 + 1)) AS BIGINT) AS crc32 FROM (SELECT {XY}, gx, gy, color FROM {{}}) GROUP BY x, y"


@query(f"{OLD}, s AS ({_TILES.format('new')}) SELECT s.z, s.x, s.y, s.crc32 FROM s WHERE NOT (x % 3 = 0)")
def ingest_anti_existing(spark: SparkSession, sf: str) -> DataFrame:
    source = checked(state(spark, sf))
    return px.ingest(source, source.where("x % 3 = 0")).select("z", "x", "y", "crc32")


@query(f"{OLD}, s AS ({_TILES.format('new')}), b AS ({_TILES.format('old')}) SELECT s.z, s.x, s.y, s.crc32 FROM s LEFT JOIN b USING (x, y) WHERE s.x % 3 <> 0 AND (b.crc32 IS NULL OR b.crc32 <> s.crc32)")
def ingest_crc_filter(spark: SparkSession, sf: str) -> DataFrame:
    source = checked(state(spark, sf))
    return px.ingest(source, source.where("x % 3 = 0"), checked(old(spark, sf))).select("z", "x", "y", "crc32")


@query(f"""{OLD}, s AS ({_TILES.format('new')}), b AS ({_TILES.format('old')})
SELECT CASE WHEN s.x % 3 = 0 THEN 'exists' WHEN b.crc32 = s.crc32 THEN 'same_crc' WHEN b.x IS NOT NULL THEN 'diff' ELSE 'full' END AS status, count(*) AS n FROM s LEFT JOIN b USING (x, y) GROUP BY 1""".replace("b.x IS NOT NULL", "b.crc32 IS NOT NULL"))
def ingest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    source = checked(state(spark, sf))
    return px.ingest_metrics(source, source.where("x % 3 = 0"), checked(old(spark, sf)))


@query(f"""{OLD}, t AS (SELECT DISTINCT CAST(gx // 16 AS INTEGER) AS x, CAST(gy // 16 AS INTEGER) AS y FROM new), h AS (SELECT DISTINCT CAST(gx // 16 AS INTEGER) AS x, CAST(gy // 16 AS INTEGER) AS y FROM old WHERE gx < 100),
v AS (SELECT DISTINCT CAST(gx // 16 AS INTEGER) AS x, CAST(gy // 16 AS INTEGER) AS y FROM new WHERE gy < 300)
SELECT CASE WHEN h.x IS NOT NULL THEN 'skipped' WHEN v.x IS NOT NULL THEN 'merged' ELSE 'empty' END AS status, count(*) AS n
FROM t LEFT JOIN h ON h.x = t.x AND h.y = t.y LEFT JOIN v ON v.x = t.x AND v.y = t.y GROUP BY 1""")
def merge_metrics(spark: SparkSession, sf: str) -> DataFrame:
    now = state(spark, sf)
    return px.merge_metrics(px.tiles(now, SIDE), px.parents(px.tiles(old(spark, sf).where("gx < 100"), SIDE)), px.tiles(now.where("gy < 300"), SIDE))


@query(f"{NEW} SELECT gx, gy, color FROM new")
def stream_pixel_state(spark: SparkSession, sf: str) -> DataFrame:
    """The same map, gathered by a stream over the table's files."""
    source = table(spark, sf, "lineitem")
    stream = as_writes(spark.readStream.schema(source.schema).parquet(f"{sf}/lineitem.parquet*"))
    path = scratch(spark, "stream")
    daily.pixel_stream(stream, ORDER, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return daily.current(spark, f"{path}/state", ORDER).where("color <> 0")


@query("SELECT count(*) AS rows, count(*) AS total, true AS timed FROM lineitem")
def stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a stream's batches took, as told while it ran; whether each has a rate."""
    source, progress = table(spark, sf, "lineitem"), rates.Progress(spark)
    stream = as_writes(spark.readStream.schema(source.schema).parquet(f"{sf}/lineitem.parquet*"))
    path = scratch(spark, "stream")
    found = rates.rates(progress.finish(daily.pixel_stream(stream, ORDER, f"{path}/state", f"{path}/checkpoint")))
    return found.agg(F.sum("rows").alias("rows"), F.max("total").alias("total"), F.bool_and(F.col("rate") > 0).alias("timed"))


# --- packed tiles --------------------------------------------------------------------------------


@query(f"{NEW} SELECT CAST({LEAF} AS INTEGER) AS z, gx, gy, color FROM new")
def png_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return packed.to_pixels(packed.to_tiles(state(spark, sf), LEAF, SIDE), SIDE)


@query(f"{NEW} SELECT CAST(5 AS INTEGER) AS z, gx, gy, color FROM ({_majority('new')})")
def packed_merge(spark: SparkSession, sf: str) -> DataFrame:
    return packed.to_pixels(packed.merge_level(packed.to_tiles(state(spark, sf), LEAF, SIDE), 5), SIDE)


@query(f"{OLD}, {BOTH} SELECT CAST({LEAF} AS INTEGER) AS z, gx, gy, n AS color FROM c WHERE b <> n AND n <> 0")
def packed_diff_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles whose checksum differs from base's, as deltas. A tile that base lacks stays whole: all its pixels differ."""
    source, base = packed.to_tiles(state(spark, sf), LEAF, SIDE), packed.to_tiles(old(spark, sf), LEAF, SIDE)
    return packed.to_pixels(packed.ingest_tiles(source, source.limit(0), base), SIDE)


@query(_diff_sql(5))
def packed_diff_merge(spark: SparkSession, sf: str) -> DataFrame:
    base, new = old(spark, sf), state(spark, sf)
    base_tiles = packed.to_tiles(base, LEAF, SIDE)
    base_tiles = base_tiles.unionAll(packed.merge_level(base_tiles, 5))
    delta = packed.ingest_tiles(packed.to_tiles(new, LEAF, SIDE), base_tiles.limit(0), base_tiles)
    return packed.to_pixels(packed.merge_level(delta, 5, base_tiles), SIDE)


@query(ORACLE_SQL["pyramid_all_levels"])
def packed_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    """All levels merged as PNG tiles; each is written before the next one reads it."""
    tiles, out = written(packed.to_tiles(state(spark, sf), LEAF, SIDE), "tiles"), []
    for z in range(LEAF - 1, -1, -1):
        tiles = written(packed.merge_level(tiles, z), "tiles")
        out.append(packed.to_pixels(tiles, SIDE))
    return reduce(DataFrame.unionAll, out)


# --- archives: written from tiles, read back -----------------------------------------------------

_LEAF_PIXELS = f"{NEW} SELECT CAST({LEAF_ZOOM} AS INTEGER) AS z, gx, gy, color FROM new"


@query(_LEAF_PIXELS)
def archive_folder(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "folder")
    writers.write_folder(packed.to_tiles(state(spark, sf), LEAF_ZOOM, SIDE * 4), path)
    return packed.to_pixels(read_tiles(spark, path), SIDE * 4)


@query(_LEAF_PIXELS)
def archive_tar(spark: SparkSession, sf: str) -> DataFrame:
    files = writers.write_archives(packed.to_tiles(state(spark, sf), LEAF_ZOOM, SIDE), scratch(spark, "tar"), "tar.gz")
    return packed.to_pixels(read_tiles(spark, ",".join(files)), SIDE)


@query(_LEAF_PIXELS)
def archive_sqlite(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each task, read back as one source."""
    files = writers.write_archives(packed.to_tiles(state(spark, sf), LEAF_ZOOM, SIDE), scratch(spark, "sqlite"), "db")
    return packed.to_pixels(read_tiles(spark, ",".join(files)), SIDE)


@query(f"{NEW} SELECT CAST({LEAF_ZOOM} AS INTEGER) AS z, gx, gy, color FROM new WHERE gx >= {SIDE * 10} AND gx < {SIDE * 21} AND gy // {SIDE} IN (3, 5, 40)")
def archive_window(spark: SparkSession, sf: str) -> DataFrame:
    """Some columns and rows of tiles: the conditions reach SQLite."""
    files = writers.write_archives(packed.to_tiles(state(spark, sf), LEAF_ZOOM, SIDE), scratch(spark, "sqlite"), "db")
    return packed.to_pixels(read_tiles(spark, ",".join(files)).where("x >= 10 and x <= 20 and y in (3, 5, 40)"), SIDE)


_ZOOM_0 = ", ".join(f"b{z} AS ({_majority(f'b{z + 1}')})" for z in range(5, -1, -1))


@query(f"""{OLD}, last AS (SELECT max(l_suppkey % 9) AS major FROM lineitem), b6 AS (SELECT gx, gy, color FROM old WHERE (SELECT major FROM last) % 2 = 0 UNION ALL SELECT gx, gy, color FROM new WHERE (SELECT major FROM last) % 2 = 1),
{_ZOOM_0}, m AS (SELECT x AS gx, y AS gy, 63 - x % 2 AS color FROM (SELECT unnest(range({SIDE})) AS x) CROSS JOIN (SELECT unnest(range({SIDE})) AS y))
SELECT 'v' || (SELECT major FROM last) AS version, CAST(m.gx AS INTEGER) AS gx, CAST(m.gy AS INTEGER) AS gy, CAST(coalesce(t.color, m.color) AS INTEGER) AS color FROM m LEFT JOIN b0 t ON t.gx = m.gx AND t.gy = m.gy""")
def preview_latest_base(spark: SparkSession, sf: str) -> DataFrame:
    """The whole map of the latest version's base, at zoom 0, on a background. Bases of even weeks have the old map, of odd ones the new."""
    major, minor = (F.col("l_suppkey") % n for n in (9, 4))
    version = F.concat(F.lit("v"), major, F.when(minor == 0, "").otherwise(F.concat(F.lit("."), F.lpad(minor.cast("string"), 3, "0"))))
    catalog = table(spark, sf, "lineitem").select(version.alias("version")).distinct()
    small = [packed.to_tiles(px.pyramid(p, LEAF, side=SIDE).where("z = 0").select("gx", "gy", "color"), 0, SIDE).withColumn("k", F.lit(i)) for i, p in enumerate((old(spark, sf), state(spark, sf)))]
    bases = spark.range(9).select(F.concat(F.lit("v"), F.col("id")).alias("version"), (F.col("id") % 2).cast("int").alias("k"))
    tiles = bases.join(small[0].unionByName(small[1]), "k")
    background = png.encode(np.tile((63 - np.arange(SIDE) % 2).astype(np.uint8), (SIDE, 1)))
    udtf.register(spark)
    packed.latest_preview(catalog, tiles, background).createOrReplaceTempView("preview")
    return spark.sql("select version, p.px as gx, p.py as gy, p.color from preview, lateral tile_decode(data) p where status = 'overlaid'")


_ODD = f"""{NEW}, t AS (SELECT DISTINCT {XY} FROM new),
r AS (SELECT CASE WHEN x % 7 = 0 THEN 'tiles/' || x || '/readme' || y || '.txt' ELSE 'tiles/' || x || '/' || y || '.png' END AS path, CASE WHEN x % 7 = 0 THEN 'name' WHEN y % 5 = 0 THEN 'image' END AS reason FROM t)"""


def odd_archives(spark: SparkSession, sf: str) -> str:
    """Archives of the map's tiles, in which some entries have no tile's name and some no image: their paths."""
    tiles = packed.to_tiles(state(spark, sf), LEAF_ZOOM, SIDE)
    name = F.when(F.col("x") % 7 == 0, F.concat(F.lit("tiles/"), "x", F.lit("/readme"), "y", F.lit(".txt"))).otherwise(F.concat(F.lit("tiles/"), "x", F.lit("/"), "y", F.lit(".png")))
    tiles = tiles.select("x", "y", F.when(F.col("y") % 5 == 0, F.lit(b"no image")).otherwise(F.col("data")).alias("data"), name.alias("name"))
    return ",".join(writers.write_archives(tiles, scratch(spark, "odd"), "tar.gz"))


@query(f"{_ODD} SELECT path, reason FROM r WHERE reason IS NOT NULL")
def archive_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that are no tiles, and why, from an ingest into a store."""
    path, store = scratch(spark, "rejects"), TileStore(spark, scratch(spark, "store"))
    api.ingest(spark, odd_archives(spark, sf), store, "v1", rejects=path)
    return spark.read.schema("path string, reason string").parquet(path)


@query(f"{_ODD} SELECT count(*) FILTER (reason IS NULL) AS tiles, count(*) FILTER (reason IS NOT NULL) AS rejected FROM r")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that an ingest gathers while it scans."""
    found = api.ingest(spark, odd_archives(spark, sf), TileStore(spark, scratch(spark, "store")), "v1", rejects=scratch(spark, "rejects"))
    return spark.createDataFrame([(found["tiles"], found["rejected"])], "tiles long, rejected long")


@query(f"{NEW} SELECT CAST({LEAF} AS INTEGER) AS z, gx, gy, color FROM new")
def tile_decode(spark: SparkSession, sf: str) -> DataFrame:
    """PNG tiles to pixels in SQL text, by a table function."""
    udtf.register(spark)
    packed.to_tiles(state(spark, sf), LEAF, SIDE).createOrReplaceTempView("own_tiles")
    return spark.sql(f"select t.z, t.x * {SIDE}L + p.px as gx, t.y * {SIDE}L + p.py as gy, p.color from own_tiles t, lateral tile_decode(t.data) p")


@query(f"{NEW} SELECT CAST({LEAF} AS INTEGER) AS z, gx, gy, color FROM new")
def tile_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a table function over whole batches of tiles."""
    udtf.register(spark)
    packed.to_tiles(state(spark, sf), LEAF, SIDE).createOrReplaceTempView("own_tiles")
    return spark.sql(f"select z, gx, gy, color from tile_pixels(table(select z, x, y, data, {SIDE} as side from own_tiles))")


# --- serving -------------------------------------------------------------------------------------

_REQUESTS = """r AS (SELECT event_id, 'v' || CAST(user_id % 3 AS VARCHAR) AS version, CASE WHEN event_id % 3 = 0 THEN '6' ELSE CAST(event_id % 14 AS VARCHAR) END AS z,
 CAST(user_id % 70 AS VARCHAR) AS x, CASE WHEN event_id % 17 = 0 THEN 'y' ELSE CAST(event_id % 70 AS VARCHAR) END AS y FROM events),
q AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN '"' || version || '-' || z || '/' || x || '/' || y || '"' END AS if_none_match FROM r)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("v"), u % 3).alias("version"), F.when(e % 3 == 0, "6").otherwise((e % 14).cast("string")).alias("z"), (u % 70).cast("string").alias("x"), F.when(e % 17 == 0, "y").otherwise((e % 70).cast("string")).alias("y"))
    return rows.withColumn("if_none_match", F.when(e % 2 == 0, F.concat(F.lit('"'), "version", F.lit("-"), "z", F.lit("/"), "x", F.lit("/"), "y", F.lit('"'))))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf).select(F.concat(F.lit("v"), F.col("gx") % 2).alias("version")).distinct()


def stored(spark: SparkSession, sf: str) -> DataFrame:
    own = px.tiles(state(spark, sf).where("gy < 400"), SIDE)
    return own.select(F.concat(F.lit("v"), F.col("x") % 2).alias("version"), F.lit(LEAF).alias("z"), "x", "y")


@query(f"""WITH e AS (SELECT event_id AS ord, 'v' || (user_id % 40) || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '_d' || event_id ELSE '_a_' || event_id END || CASE WHEN event_id % 5 = 0 THEN '.png' ELSE '.db' END AS name FROM events WHERE event_id % 13 <> 0),
p AS (SELECT ord, name, str_split(substr(name, 1, length(name) - 3), '_') AS s FROM e WHERE name LIKE '%.db')
SELECT version, description, name FROM (SELECT s[1] AS version, CASE WHEN len(s) = 2 THEN s[2] ELSE '' END AS description, name, row_number() OVER (PARTITION BY s[1] ORDER BY ord DESC) AS rn FROM p) WHERE rn = 1""")
def serving_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Versions and descriptions from file names, which are made from events (a thirteenth are folders)."""
    e = F.col("event_id")
    tail = F.when(e % 3 == 0, "").when(e % 3 == 1, F.concat(F.lit("_d"), e)).otherwise(F.concat(F.lit("_a_"), e))
    name = F.concat(F.lit("v"), F.col("user_id") % 40, tail, F.when(e % 5 == 0, ".png").otherwise(".db"))
    return planner.catalog(table(spark, sf, "events").select(name.alias("name"), (e % 13 == 0).alias("is_dir"), e.alias("ord")))


@query(f"""{NEW}, {_REQUESTS},
t AS (SELECT DISTINCT 'v' || CAST(x % 2 AS VARCHAR) AS version, x, y FROM (SELECT {XY} FROM new WHERE gy < 400)), k AS (SELECT DISTINCT 'v' || CAST(gx % 2 AS VARCHAR) AS version FROM new),
a AS (SELECT q.*, TRY_CAST(z AS INTEGER) AS iz, TRY_CAST(x AS INTEGER) AS ix, TRY_CAST(y AS INTEGER) AS iy FROM q),
s AS (SELECT a.event_id, a.version, a.z, a.x, a.y, a.if_none_match, CASE WHEN iz IS NULL OR ix IS NULL OR iy IS NULL OR iz > 11 OR ix >= pow(2, iz) OR iy >= pow(2, iz) THEN 400 WHEN k.version IS NULL THEN 500 WHEN t.x IS NULL THEN 404
 WHEN if_none_match IS NOT NULL THEN 304 ELSE 200 END AS status FROM a LEFT JOIN k ON k.version = a.version LEFT JOIN t ON t.version = a.version AND iz = {LEAF} AND t.x = ix AND t.y = iy)
SELECT event_id, version, z, x, y, if_none_match, CAST(status AS INTEGER) AS status, CASE WHEN status IN (200, 304) THEN '"' || version || '-' || z || '/' || x || '/' || y || '"' END AS etag FROM s""")
def request_status(spark: SparkSession, sf: str) -> DataFrame:
    return px.serve(requests(spark, sf), versions(spark, sf), stored(spark, sf))


@query(f"""{NEW}, {_REQUESTS},
t AS (SELECT DISTINCT 'v' || CAST(x % 2 AS VARCHAR) AS version, x, y FROM (SELECT {XY} FROM new WHERE gy < 400)), k AS (SELECT DISTINCT 'v' || CAST(gx % 2 AS VARCHAR) AS version FROM new),
a AS (SELECT *, '/tiles/' || CASE WHEN event_id % 23 = 0 THEN upper(version) ELSE version END || '/' || z || '/' || CASE WHEN event_id % 19 = 0 THEN '+' ELSE '' END || x || '/' || y || '.png' AS path,
 event_id % 23 <> 0 AND event_id % 19 <> 0 AND event_id % 17 <> 0 AS routed, TRY_CAST(z AS INTEGER) AS iz, TRY_CAST(x AS INTEGER) AS ix, TRY_CAST(y AS INTEGER) AS iy FROM q)
SELECT a.event_id, a.path, CAST(CASE WHEN NOT routed THEN 404 WHEN iz > 11 OR ix >= pow(2, iz) OR iy >= pow(2, iz) THEN 400 WHEN k.version IS NULL THEN 500 WHEN t.x IS NULL THEN 404
 WHEN if_none_match IS NOT NULL THEN 304 ELSE 200 END AS INTEGER) AS status FROM a LEFT JOIN k ON k.version = a.version LEFT JOIN t ON t.version = a.version AND iz = {LEAF} AND t.x = ix AND t.y = iy""")
def request_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Status of requests given as paths, some of which no route takes: a sign before a number, a version in capitals."""
    e = F.col("event_id")
    path = F.concat(F.lit("/tiles/"), F.when(e % 23 == 0, F.upper("version")).otherwise(F.col("version")), F.lit("/"), "z", F.lit("/"), F.when(e % 19 == 0, "+").otherwise(""), "x", F.lit("/"), "y", F.lit(".png"))
    own = requests(spark, sf).select("event_id", path.alias("path"), "if_none_match")
    return px.serve_paths(own, versions(spark, sf), stored(spark, sf)).select("event_id", "path", "status")


@query(f"""{NEW}, {_REQUESTS}, t AS (SELECT x, y, count(*) AS pixels FROM (SELECT {XY} FROM new) GROUP BY x, y)
SELECT event_id, t.x, t.y, t.pixels FROM q JOIN t ON q.z = '{LEAF}' AND q.x = CAST(t.x AS VARCHAR) AND q.y = CAST(t.y AS VARCHAR)""")
def tile_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = requests(spark, sf).where(f"z = '{LEAF}'").select("event_id", tf.whole_number(F.col("x")).alias("x"), tf.whole_number(F.col("y")).alias("y"))
    return wanted.join(px.tiles(state(spark, sf), SIDE), ["x", "y"]).select("event_id", "x", "y", "pixels")


# --- versions and plans --------------------------------------------------------------------------

_HOURS = "hours AS (SELECT event_id, ts, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '{e}')) // 3600000000 AS BIGINT) AS h FROM events)"
_V = f"WITH {_HOURS.format(e=EPOCH)}, v AS (SELECT event_id, ts, CAST(h // 168 AS INTEGER) AS major, CAST(h % 168 AS INTEGER) AS minor FROM hours)"
_VS = "'v' || major || '.' || lpad(CAST(minor AS VARCHAR), 3, '0')"
_HOUR = "strftime(ts, '%Y-%m-%dT%H')"


def archives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("dt"))
    return rows.withColumn("v", tf.version_of(F.col("dt"), EPOCH)).select("event_id", "dt", "v")


@query(f"WITH {_HOURS.format(e='2025-01-01')} SELECT event_id, CAST(h // 168 AS INTEGER) AS major, CAST(h % 168 AS INTEGER) AS minor FROM hours")
def version_from_ts(spark: SparkSession, sf: str) -> DataFrame:
    v = tf.version_of(F.col("ts"))
    return table(spark, sf, "events").select("event_id", v["major"].alias("major"), v["minor"].alias("minor"))


@query(f"{_V} SELECT event_id, {_VS} AS version, 'v' || major AS base, {_VS} || '_' || {_HOUR} || '.db' AS name FROM v")
def version_format_output_name(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    base = F.struct(v["major"].alias("major"), v["minor"].alias("minor"), F.lit(True).alias("is_base"))
    return archives(spark, sf).select("event_id", tf.format_version(v).alias("version"), tf.format_version(base).alias("base"), tf.output_name(v, F.col("dt")).alias("name"))


@query(f"""{_V} SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN major END AS major, CASE WHEN event_id % 5 IN (1, 2) THEN minor WHEN event_id % 5 IN (0, 3) THEN 0 END AS minor,
CASE WHEN event_id % 5 <> 4 THEN event_id % 5 IN (0, 3) END AS is_base FROM v""")
def version_parse(spark: SparkSession, sf: str) -> DataFrame:
    v, e = F.col("v"), F.col("event_id") % 5
    full = tf.format_version(v)
    text = F.when(e == 0, F.concat(F.lit("v"), v["major"])).when(e == 1, full).when(e == 2, F.concat(full, F.lit("x"))).when(e == 3, F.concat(v["major"].cast("string"), F.lit("-b"))).otherwise(F.concat(full, F.lit(".1")))
    p = tf.parse_version(text)
    return archives(spark, sf).select("event_id", p["major"].alias("major"), p["minor"].alias("minor"), p["is_base"].alias("is_base"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN epoch_us(date_trunc('second', ts)) END AS us FROM events")
def filename_to_ts(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH-mm-ss'Z'")
    name = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("full/full_"), F.date_format("ts", "yyyy-MM-dd HH"), F.lit(".db"))).otherwise(F.concat(F.lit("full/full_"), stamp, F.lit(".db")))
    return table(spark, sf, "events").select("event_id", F.unix_micros(tf.archive_time(name)).alias("us"))


_DONE = f"""{_V}, n AS (SELECT event_id AS ord, ts, major, minor, event_id % 7 = 0 AS is_base, CASE WHEN event_id % 7 = 0 THEN 'v' || major ELSE {_VS} END || '_' || {_HOUR} || CASE WHEN event_id % 11 = 0 THEN '.png' ELSE '.db' END AS name FROM v WHERE day(ts) % 7 = 3),
d AS (SELECT ord, name, major, minor, is_base, date_trunc('hour', ts) AS dt FROM n WHERE name LIKE '%.db')"""


_DONE_ALL = _DONE.replace(" WHERE day(ts) % 7 = 3", "")


def finished(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """Done archives: names made from the events of every seventh day (or of all days), read back."""
    v, own = F.col("v"), archives(spark, sf)
    own = own if every else own.where(F.dayofmonth("dt") % 7 == 3)
    version = F.struct(v["major"].alias("major"), v["minor"].alias("minor"), (F.col("event_id") % 7 == 0).alias("is_base"))
    name = tf.output_name(version, F.col("dt"))
    name = F.when(F.col("event_id") % 11 == 0, F.regexp_replace(name, r"\.db$", ".png")).otherwise(name)
    return planner.done(own.select(name.alias("name"), F.lit(False).alias("is_dir"), F.col("event_id").alias("ord")))


@query(f"{_DONE} SELECT name, ord, epoch_us(dt) AS us FROM d ORDER BY dt DESC, ord LIMIT 1")
def done_latest(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_latest(finished(spark, sf)).select("name", "ord", F.unix_micros("dt").alias("us"))


@query(f"{_DONE} SELECT DISTINCT CAST(dt AS DATE) AS day FROM d")
def done_days(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_days(finished(spark, sf))


@query(f"{_DONE} SELECT major, arg_max(name, ord) FILTER (is_base) AS base, array_to_string(list(name ORDER BY ord) FILTER (NOT is_base), ',') AS diffs FROM d GROUP BY major")
def done_by_major(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_by_major(finished(spark, sf)).withColumn("diffs", F.array_join("diffs", ","))


@query(f"{_DONE_ALL} SELECT name, ord, epoch_us(dt) AS us FROM d ORDER BY dt DESC, ord LIMIT 1")
def done_all_latest(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_latest(finished(spark, sf, every=True)).select("name", "ord", F.unix_micros("dt").alias("us"))


@query(f"{_DONE_ALL} SELECT DISTINCT CAST(dt AS DATE) AS day FROM d")
def done_all_days(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_days(finished(spark, sf, every=True))


@query(f"{_DONE_ALL} SELECT major, arg_max(name, ord) AS base FROM d WHERE is_base GROUP BY major")
def done_all_bases(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_bases(finished(spark, sf, every=True))


@query(f"{_DONE_ALL} SELECT major, row_number() OVER (PARTITION BY major ORDER BY ord) AS position, name FROM d WHERE NOT is_base")
def done_all_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return planner.done_diffs(finished(spark, sf, every=True))


@query(f"""{_DONE_ALL}, u AS (SELECT DISTINCT name, major, is_base FROM d)
SELECT major, max(name) FILTER (is_base) AS base, count(*) FILTER (NOT is_base) AS diffs, max(name) FILTER (NOT is_base) AS last_diff FROM u GROUP BY major""")
def done_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Per major its base and diffs, from a folder of files with the finished archives' names (and others) that is listed."""
    v, own = F.col("v"), archives(spark, sf)
    version = F.struct(v["major"].alias("major"), v["minor"].alias("minor"), (F.col("event_id") % 7 == 0).alias("is_base"))
    name = tf.output_name(version, F.col("dt"))
    name = F.when(F.col("event_id") % 11 == 0, F.regexp_replace(name, r"\.db$", ".png")).otherwise(name)
    path = scratch(spark, "done")
    writers.write_names(own.select(name.alias("name")).distinct(), path)
    rows = planner.done(read_entries(spark, path))
    diff = ~F.col("is_base")
    counts = rows.groupBy("major").agg(F.count_if(diff).alias("diffs"), F.max(F.when(diff, F.col("name"))).alias("last_diff"))
    return counts.join(planner.done_bases(rows), "major", "left").select("major", "base", "diffs", "last_diff")


_PLAN = f"""{_DONE}, f AS (SELECT * FROM d WHERE major < 2),
a AS (SELECT ts, major, minor FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, major, minor) AS rn FROM v) WHERE rn = 1 AND CAST(ts AS DATE) NOT IN (SELECT CAST(dt AS DATE) FROM f)),
b AS (SELECT major, arg_max(name, ord) FILTER (is_base) AS done_base FROM f GROUP BY major),
w AS (SELECT a.*, done_base, row_number() OVER (PARTITION BY a.major ORDER BY ts) AS k, first_value(a.ts) OVER (PARTITION BY a.major ORDER BY ts) AS first FROM a LEFT JOIN b USING (major))"""


@query(f"""{_PLAN} SELECT epoch_us(ts) AS us, major, minor, done_base IS NOT NULL OR k > 1 AS is_diff,
CASE WHEN done_base IS NOT NULL THEN done_base WHEN k > 1 THEN 'v' || major || '_' || strftime(first, '%Y-%m-%dT%H') || '.db' END AS base,
CASE WHEN done_base IS NOT NULL OR k > 1 THEN {_VS} ELSE 'v' || major END || '_' || {_HOUR} || '.db' AS name FROM w""")
def plan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = planner.plan(archives(spark, sf).select("dt", "v.major", "v.minor"), finished(spark, sf).where("major < 2"))
    return jobs.select(F.unix_micros("dt").alias("us"), "major", "minor", "is_diff", "base", "name")


@query(f"""{_PLAN}, j AS (SELECT done_base IS NOT NULL OR k > 1 AS is_diff, CASE WHEN done_base IS NOT NULL THEN done_base WHEN k > 1 THEN 'v' || major || '_' || strftime(first, '%Y-%m-%dT%H') || '.db' END AS base,
CASE WHEN done_base IS NOT NULL OR k > 1 THEN {_VS} ELSE 'v' || major END || '_' || {_HOUR} || '.db' AS name FROM w)
SELECT name || CASE WHEN is_diff THEN ' DIFF from ' || base ELSE ' FULL' END AS line FROM j""")
def plan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The plan as it is shown before it runs."""
    jobs = planner.plan(archives(spark, sf).select("dt", "v.major", "v.minor"), finished(spark, sf).where("major < 2"))
    return planner.described(jobs).select("line")


@query(f"{_V} SELECT epoch_us(ts) AS us, major, minor, 'v' || major || '_' || {_HOUR} || '.db' AS name FROM v ORDER BY ts DESC, major, minor LIMIT 1")
def plan_latest(spark: SparkSession, sf: str) -> DataFrame:
    last = planner.plan_latest(archives(spark, sf).select("dt", "v.major", "v.minor"))
    return last.select(F.unix_micros("dt").alias("us"), "major", "minor", "name")


@query(f"""{_V}, t AS (SELECT DISTINCT CASE WHEN minor % 2 = 0 THEN 'v' || major ELSE {_VS} END AS version FROM v)
SELECT version, CAST(row_number() OVER (ORDER BY CAST(substr(version, 2) AS DOUBLE), version) AS INTEGER) AS place FROM t""")
def version_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct versions (one for each hour at most) with their places in order."""
    v = F.col("v")
    version = F.struct(v["major"].alias("major"), v["minor"].alias("minor"), (v["minor"] % 2 == 0).alias("is_base"))
    own = archives(spark, sf).select(tf.format_version(version).alias("version")).distinct()
    return own.withColumn("place", F.row_number().over(Window.orderBy(*tf.version_sort_key(F.col("version")))))


@query("""SELECT event_id, 'https://host.example/b/resolve/full/full_' || strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '.db' AS url, epoch_us(date_trunc('second', ts)) AS us,
CAST(h // 168 AS INTEGER) AS major, CAST(h % 168 AS INTEGER) AS minor FROM (SELECT *, CAST((epoch_us(date_trunc('second', ts)) - epoch_us(TIMESTAMP '2025-01-01')) // 3600000000 AS BIGINT) AS h FROM events) WHERE event_id % 3 <> 0 AND event_id % 5 <> 0""")
def remote_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a listing made from events: files in the folder, with times, versions and download URLs."""
    e = F.col("event_id")
    path = F.concat(F.when(e % 5 == 0, "other/full_").otherwise("full/full_"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit(".db"))
    entries = table(spark, sf, "events").select(path.alias("path"), e.alias("size"), F.when(e % 3 == 0, "directory").otherwise("file").alias("type"))
    return planner.listing(entries, "full/").select(F.col("size").alias("event_id"), tf.download_url(F.lit("https://host.example/b/tree/main/full"), F.col("path")).alias("url"), F.unix_micros("dt").alias("us"), "major", "minor")
