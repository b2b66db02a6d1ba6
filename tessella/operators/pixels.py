"""Operators on pixel relations (gx, gy, color): an absent pixel is transparent (0).

All are lazy DataFrame compositions. (gx, gy) is unique in each relation, as `latest` leaves it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.model import color_channels, palette

AT = ["gx", "gy"]
STRATEGIES = ("majority", "mode", "weighted")
WORD = 32  # bits of a block's pixels in one number


def latest(writes: DataFrame, order: list[str], keys: list[str] = AT, value: str = "color") -> DataFrame:
    """Keyed upsert: the value of each key's last write (by order, then by value). One partial aggregate."""
    last = F.max(F.struct(*order, F.col(value).alias("__value")))
    return writes.groupBy(*keys).agg(last["__value"].alias(value))


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """store with incoming rows in place of those with equal keys; of several incoming ones the first by order, or any."""
    first = incoming.dropDuplicates(keys) if order is None else incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return store.join(incoming.select(*keys), keys, "left_anti").unionByName(first)


def tile_of(pixels: DataFrame, side: int) -> DataFrame:
    """pixels with their tile's x and y."""
    return pixels.withColumns({"x": F.expr(f"gx div {side}").cast("int"), "y": F.expr(f"gy div {side}").cast("int")})


def tiles(pixels: DataFrame, side: int) -> DataFrame:
    """Tiles with a visible pixel: x, y, pixels, colors."""
    return tile_of(pixels.where("color <> 0"), side).groupBy("x", "y").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("color").alias("colors"))


def parents(tiles: DataFrame) -> DataFrame:
    """Distinct parents of tiles."""
    return tiles.select(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct()


def quantise(pixels: DataFrame) -> DataFrame:
    """(gx, gy, r, g, b, a) to palette indices: alpha-premultiplied 8-bit channels are looked up; no match is 0.

    The palette has 63 rows, always.
    """
    def premultiplied(c: str) -> Column:
        return F.shiftright(F.expr(f"{c} * 257 * a div 255").cast("int"), 8)

    own = pixels.withColumns({f"__{c}": premultiplied(c) for c in "rgb"})
    table = palette(pixels.sparkSession).select(F.col("idx"), *(F.col(c).alias(f"__{c}") for c in "rgb"))
    found = own.join(F.broadcast(table), [f"__{c}" for c in "rgb"], "left")
    return found.select(*AT, F.when(F.col("a") == 0, 0).otherwise(F.coalesce("idx", F.lit(0))).cast("int").alias("color"))


def compared(base: DataFrame, new: DataFrame) -> DataFrame:
    """gx, gy, b, n: colours of both, 0 where absent."""
    left, right = base.select(*AT, F.col("color").alias("b")), new.select(*AT, F.col("color").alias("n"))
    return left.join(right, AT, "full_outer").select(*AT, F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("n", F.lit(0)).alias("n"))


def diff(base: DataFrame, new: DataFrame, exact: bool = False) -> DataFrame:
    """Changed pixels with their new colour. A pixel that became transparent is not in the result: undiff
    restores its old colour, as in the stored form. exact keeps it (color 0, erased true)."""
    changed = compared(base, new).where("b <> n")
    if exact:
        return changed.select(*AT, F.col("n").alias("color"), (F.col("n") == 0).alias("erased"))
    return changed.where("n <> 0").select(*AT, F.col("n").alias("color"))


def changed_tiles(base: DataFrame, new: DataFrame, side: int) -> DataFrame:
    """Tiles with a changed pixel, erased ones included: x, y, changed, erased."""
    changed = tile_of(compared(base, new).where("b <> n"), side)
    return changed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("n") == 0).alias("erased"))


def undiff(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base overlaid by a delta: where it has no colour, base shows."""
    both = compared(base, delta)
    return both.select(*AT, F.when(F.col("n") == 0, F.col("b")).otherwise(F.col("n")).alias("color")).where("color <> 0")


def exact_undiff(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base overlaid by a delta of diff(exact=True): the new map itself."""
    kept = base.join(delta.select(*AT), AT, "left_anti").select(*AT, "color")
    return kept.unionByName(delta.where("not erased").select(*AT, "color"))


def overlay(bottom: DataFrame, top: DataFrame) -> DataFrame:
    """top wins where it is visible."""
    return undiff(bottom, top)


def _quarter() -> Column:
    """Place in the 2x2 block: 0 top left, 1 top right, 2 bottom left, 3 bottom right."""
    return F.col("gx").bitwiseAND(1) + F.col("gy").bitwiseAND(1) * 2


def _best(cells: list[Column], count_transparent: bool) -> Column:
    """Most frequent of four values, of several the first one; transparent ones count or not."""
    def key(i: int, value: Column) -> Column:
        n = reduce(lambda a, c: a + c, ((value == c).cast("long") for c in cells))
        packed = n * (1 << 40) + (3 - i) * (1 << 36) + value
        return packed if count_transparent else F.when(value == 0, F.lit(0)).otherwise(packed)

    return F.greatest(*(key(i, c) for i, c in enumerate(cells))).bitwiseAND((1 << 36) - 1)


def _quads(pixels: DataFrame, carry: list[str]) -> DataFrame:
    """Per 2x2 block its four colours q0..q3: fixed-width maxima, so that the aggregate is a hash aggregate."""
    place = _quarter()
    cells = [F.coalesce(F.max(F.when(place == i, F.col("color"))), F.lit(0)).cast("long").alias(f"q{i}") for i in range(4)]
    return pixels.groupBy(*carry, F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(*cells)


def downsample(pixels: DataFrame, strategy: str = "majority", carry: list[str] | None = None) -> DataFrame:
    """Halves the map. majority: most frequent visible colour; mode: transparent counts too; weighted: see block_mode.

    Ties go to the first of top left, top right, bottom left, bottom right. A colour may be any number
    under 2^36, such as packed RGBA. carry: columns that are equal within a block and stay (a
    partitioning on them is kept).
    """
    if strategy == "weighted":
        return block_mode(pixels, 2)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    carry = carry or []
    cells = [F.col(f"q{i}") for i in range(4)]
    return _quads(pixels, carry).select(*carry, *AT, _best(cells, strategy == "mode").cast(pixels.schema["color"].dataType).alias("color")).where("color <> 0")


def block_mode(pixels: DataFrame, block: int) -> DataFrame:
    """Weighted mode of block x block pixels: a visible pixel weighs `block`, a transparent one 1.

    Ties go to the colour whose last pixel in row order comes first. Which pixels are there is kept in words of
    WORD bits, so that both aggregates are hash aggregates; block is 32 at most (32 words).
    """
    if not 2 <= block <= 32:
        raise ValueError("block must be 2 to 32")
    place = (F.col("gx") % block + F.col("gy") % block * block).cast("int")
    at = [F.expr(f"gx div {block}").alias("gx"), F.expr(f"gy div {block}").alias("gy")]
    words = range(-(-block * block // WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % WORD)
    bits = [F.bit_or(F.when(F.floor(place / WORD) == w, bit).otherwise(0)).alias(f"w{w}") for w in words]
    each = pixels.groupBy(*at, "color").agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("last"), *bits)
    best = F.max(F.struct((F.col("n") * block).alias("weight"), (-F.col("last")).alias("early"), F.col("color")))
    whole = each.groupBy(*AT).agg(best.alias("best"), F.sum("n").alias("n"), *(F.bit_or(f"w{w}").alias(f"w{w}") for w in words))
    missing = [F.lit((1 << min(WORD, block * block - WORD * w)) - 1).cast("long").bitwiseXOR(F.col(f"w{w}")) for w in words]
    # The highest word with a missing pixel, and its highest bit; a word is exact as a float.
    last_missing = F.coalesce(*(F.when(m != 0, WORD * w + F.floor(F.log2(m.cast("double") + 0.5)).cast("long")) for w, m in reversed([*enumerate(missing)])))
    none = F.lit(block * block) - F.col("n")
    transparent = (none > F.col("best.weight")) | ((none == F.col("best.weight")) & (last_missing < -F.col("best.early")))
    return whole.where(~F.coalesce(transparent, F.lit(False))).select(*AT, F.col("best.color").alias("color"))


def average(pixels: DataFrame) -> DataFrame:
    """Halves the map to r, g, b, a: the mean of the four pixels' 16-bit channels, transparent ones as zeros."""
    channels = {n: c * 257 for n, c in zip("rgba", color_channels(F.col("color")))}
    own = pixels.select(*AT, *(c.alias(n) for n, c in channels.items()))
    mean = [F.shiftright(F.expr(f"sum({n}) div 4").cast("int"), 8).alias(n) for n in "rgba"]
    return own.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(*mean)


def complete_parents(tiles: DataFrame) -> DataFrame:
    """Parents of which all four children are among tiles."""
    own = tiles.select("x", "y").distinct().groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
    return own.agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("x", "y")


def average_tiles(pixels: DataFrame, tiles: DataFrame, side: int) -> DataFrame:
    """average() of the parents that have all four children."""
    return tile_of(average(pixels), side).join(complete_parents(tiles), ["x", "y"], "left_semi").drop("x", "y")


def pyramid(pixels: DataFrame, leaf_zoom: int, coarsest: int = 0, strategy: str = "majority", shuffle_zoom: int | None = None, side: int = 1000, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All levels below leaf_zoom: z, gx, gy, color.

    Levels down to shuffle_zoom (halfway by default) are computed within a partitioning by that
    level's tiles, so that each of them needs no shuffle of its own; what is left there is dealt once more.
    With keep (which writes a table and reads it again) each level starts from the one before, computed
    once; without, the result is one lazy plan, in which the levels above a cut are computed for each below.
    """
    if keep:
        levels, now = [], pixels.select(*AT, "color")
        for z in range(leaf_zoom - 1, coarsest - 1, -1):
            now = keep(downsample(now, strategy))
            levels.append(now.select(F.lit(z).alias("z"), *AT, "color"))
        return reduce(DataFrame.unionAll, levels)
    cut = (leaf_zoom + coarsest) // 2 if shuffle_zoom is None else shuffle_zoom
    levels, now, z = [], pixels.select(*AT, "color"), leaf_zoom
    while z > coarsest:
        top = cut if z > cut else coarsest
        span = side << (z - top)
        now = now.withColumns({"__x": F.expr(f"gx div {span}"), "__y": F.expr(f"gy div {span}")}).repartition("__x", "__y")
        while z > top:
            now, z = downsample(now, strategy, ["__x", "__y"]) if strategy != "weighted" else block_mode(now, 2), z - 1
            levels.append(now.select(F.lit(z).alias("z"), *AT, "color"))
        now = now.select(*AT, "color")
    return reduce(DataFrame.unionAll, levels)


def _within(pixels: DataFrame, tiles: DataFrame, side: int, how: str = "left_semi", up: int = 0) -> DataFrame:
    """Pixels (gx, gy, color) in tiles (x, y); up: of how many zooms above the tiles are."""
    span = side << up
    own = pixels.withColumns({"x": F.expr(f"gx div {span}").cast("int"), "y": F.expr(f"gy div {span}").cast("int")})
    return own.join(tiles.select("x", "y"), ["x", "y"], how).select(*AT, "color")


def refreshed(pixels: DataFrame, touched: DataFrame, levels: DataFrame, leaf_zoom: int, side: int, keep: Callable[[DataFrame], DataFrame], coarsest: int = 0, strategy: str = "majority") -> tuple[DataFrame, DataFrame]:
    """What a change of leaf tiles does to a pyramid: (pixels z, gx, gy, color of the rebuilt tiles, their z, x, y).

    pixels is the new leaf map, touched (x, y) the leaf tiles that may have changed, levels (z, gx, gy, color) the pyramid
    of the map before. Only parents of changed tiles are built, of their four children; one that comes out as it was
    isn't rebuilt, and nothing above it is. Each zoom reads the level's pixels under these parents alone, and is written
    (keep) before the next; it ends where no tile changes. `patched` puts the result in place.
    """
    now, dirty, new, keys = pixels.select(*AT, "color"), touched.select("x", "y").distinct(), [], []
    for z in range(leaf_zoom - 1, coarsest - 1, -1):
        above = parents(dirty)
        children = _within(now, above, side, up=1)
        if z < leaf_zoom - 1:  # now: the rebuilt tiles of the zoom below; the other children are as before
            before = levels.where(F.col("z") == z + 1).select(*AT, "color")
            children = children.unionByName(_within(_within(before, above, side, up=1), dirty, side, "left_anti"))
        both = tile_of(compared(_within(levels.where(F.col("z") == z), above, side), downsample(children, strategy)), side)
        changed = F.max(F.col("b") != F.col("n")).over(Window.partitionBy("x", "y"))
        rebuilt = keep(both.withColumn("changed", changed).where("changed").select(*AT, "x", "y", F.col("n").alias("color")))
        now, dirty = rebuilt.where("color <> 0").select(*AT, "color"), rebuilt.select("x", "y").distinct()
        new.append(now.select(F.lit(z).alias("z"), *AT, "color"))
        keys.append(dirty.select(F.lit(z).alias("z"), "x", "y"))
        if rebuilt.isEmpty():
            break
    return reduce(DataFrame.unionAll, new), reduce(DataFrame.unionAll, keys)


def patched(levels: DataFrame, pixels: DataFrame, tiles: DataFrame, side: int) -> DataFrame:
    """levels (z, gx, gy, color) with the rebuilt tiles (z, x, y) replaced by their new pixels."""
    kept = tile_of(levels, side).join(tiles.select("z", "x", "y"), ["z", "x", "y"], "left_anti").select("z", *AT, "color")
    return kept.unionByName(pixels.select("z", *AT, "color"))


def diff_level(target: DataFrame, target_tiles: DataFrame, base: DataFrame, base_tiles: DataFrame, base_parents: DataFrame, base_parent_tiles: DataFrame, side: int, existing: DataFrame | None = None, propagate_new: bool = False) -> tuple[DataFrame, DataFrame]:
    """One zoom step of a delta map: (pixels, tiles x, y) of the parents' delta.

    target and base are a level's pixels, *_tiles its tiles (x, y; a tile may have no visible pixel).
    A child counts if both have its tile (propagate_new: or the target alone); its pixels are base
    overlaid by target. The parents' majority is then held against the base's parents: unchanged
    parents are dropped, changed ones keep their changed visible pixels; without a base parent all.
    Parents in existing (x, y) are left out.
    """
    xy = ["x", "y"]
    both = target_tiles.select(*xy).join(base_tiles.select(*xy), xy, "left_semi")
    alone = target_tiles.select(*xy).join(base_tiles.select(*xy), xy, "left_anti")
    children = both.unionByName(alone) if propagate_new else both
    made = parents(children)
    if existing is not None:
        made = made.join(existing.select(*xy), xy, "left_anti")
    within = lambda p, t: tile_of(p, side).join(t, xy, "left_semi").select(*AT, "color")
    merged = downsample(undiff(within(base, both), within(target, children)))
    merged = tile_of(merged, side).join(made, xy, "left_semi").select(*AT, "color")
    old = base_parent_tiles.select(*xy).withColumn("has", F.lit(True))
    compare = tile_of(compared(within(base_parents, made), merged), side).join(old, xy, "left")
    changed = compare.where("has and b <> n").select(*xy).distinct()
    fresh = made.join(old, xy, "left_anti")
    pixels = compare.where("n <> 0 and (has is null or b <> n)").select(*AT, F.col("n").alias("color"))
    return pixels, changed.unionByName(fresh)


def diff_pyramid(base: DataFrame, new: DataFrame, leaf_zoom: int, side: int, keep: Callable[[DataFrame], DataFrame], coarsest: int = 0) -> DataFrame:
    """All levels below leaf_zoom of the delta between two maps: z, gx, gy, color; each as diff_level gives it.

    One relation carries both maps: gx, gy, b (the base's colour), d (the delta's) and live (the pixel's tile is in
    the delta and in the base, so that it counts as a child). A level is one aggregate of the quads and one window over
    its tiles, dealt by tile once, and is written (keep) before the next one starts from it.
    """
    now = compared(base, new).select(*AT, "b", F.when((F.col("b") != F.col("n")) & (F.col("n") != 0), F.col("n")).otherwise(0).alias("d"), (F.col("b") != F.col("n")).alias("changed"))
    levels = []
    for z in range(leaf_zoom, coarsest - 1, -1):
        tile = Window.partitionBy("x", "y")
        own = now.withColumns({"x": F.expr(f"gx div {side}").cast("int"), "y": F.expr(f"gy div {side}").cast("int")})
        has = F.max(F.col("b") != 0).over(tile)
        if z == leaf_zoom:
            own = own.select(*AT, "b", "d", (has & F.max("changed").over(tile)).alias("live"))
        else:  # b: the base's parent, u: of the overlaid children; made: a child counted
            own = own.withColumns({"has": has, "made": F.max("made").over(tile)})
            differs = F.col("made") & (F.col("b") != F.col("u"))
            own = own.select(*AT, "x", "y", "b", "has", F.when(F.col("made") & (F.col("u") != 0) & (~F.col("has") | (F.col("b") != F.col("u"))), F.col("u")).otherwise(0).alias("d"), "made", differs.alias("differs"))
            own = keep(own.select(*AT, "b", "d", (F.col("has") & F.max("differs").over(tile)).alias("live")))
            levels.append(own.where("d <> 0").select(F.lit(z).alias("z"), *AT, F.col("d").alias("color")))
        now = _delta_parents(own)
    return reduce(DataFrame.unionAll, levels)


def delta_levels(base: DataFrame, delta: DataFrame, touched: DataFrame, levels: DataFrame, leaf_zoom: int, side: int, keep: Callable[[DataFrame], DataFrame], coarsest: int = 0) -> DataFrame:
    """diff_pyramid of a base whose own pyramid is stored: z, gx, gy, color, the same rows.

    base: its leaf map; levels (z, gx, gy, color): its pyramid; delta: the leaf delta's pixels, touched (x, y) its tiles.
    Each zoom reads of the base only what lies under parents of delta tiles, so that time follows the delta.
    """
    live, top, out = touched.select("x", "y").distinct(), base.select(*AT, "color"), []
    delta, tile, place = delta.select(*AT, "color"), Window.partitionBy("x", "y"), _quarter()
    for z in range(leaf_zoom - 1, coarsest - 1, -1):
        # A delta tile counts as a child if the base has the tile, too.
        own = tile_of(compared(_within(top, live, side), _within(delta, live, side)), side)
        own = own.withColumn("has", F.max(F.col("b") != 0).over(tile)).where("has")
        over = F.when(F.col("n") != 0, F.col("n")).otherwise(F.col("b"))
        cells = [F.coalesce(F.max(F.when(place == i, over)), F.lit(0)).cast("long").alias(f"q{i}") for i in range(4)]
        quads = own.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(*cells)
        merged = quads.select(*AT, _best([F.col(f"q{i}") for i in range(4)], False).cast("int").alias("u"), F.lit(True).alias("made"))
        top = levels.where(F.col("z") == z).select(*AT, "color")
        old = _within(top, parents(live), side).withColumnRenamed("color", "b")
        both = tile_of(old.join(merged, AT, "full_outer").select(*AT, F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("made", F.lit(False)).alias("made")), side)
        both = both.withColumns({"has": F.max(F.col("b") != 0).over(tile), "made": F.max("made").over(tile)})
        changed = keep(both.where("made and b <> u").select(*AT, "x", "y", "u", "has"))
        delta = changed.where("u <> 0").select(*AT, F.col("u").alias("color"))
        live = changed.where("has").select("x", "y").distinct()
        out.append(delta.select(F.lit(z).alias("z"), *AT, "color"))
        if changed.isEmpty():
            break
    return reduce(DataFrame.unionAll, out)


def _delta_parents(pixels: DataFrame) -> DataFrame:
    """gx, gy, b, u and made of the level above: majorities of the base and of the base overlaid by the delta in live tiles."""
    place = _quarter()
    over = F.when(F.col("live"), F.when(F.col("d") != 0, F.col("d")).otherwise(F.col("b"))).otherwise(0)
    cells = [F.coalesce(F.max(F.when(place == i, c)), F.lit(0)).cast("long").alias(f"{n}{i}") for n, c in (("b", F.col("b")), ("u", over)) for i in range(4)]
    quads = pixels.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(*cells, F.max("live").alias("made"))
    best = {n: _best([F.col(f"{n}{i}") for i in range(4)], False).cast("int").alias(n) for n in "bu"}
    return quads.select(*AT, best["b"], best["u"], "made").where("b <> 0 or u <> 0 or made")


def ingest(source: DataFrame, target: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Source tiles (keys z, x, y; crc32; any payload) still to store: absent in target and, with a base, of another crc32.

    Keys and checksums decide first; only then is the payload of what is left looked up. Of source rows with equal
    keys that with the least checksum is taken. A base row without a checksum never matches.
    """
    keys = ["z", "x", "y"]
    slim = source.groupBy(*keys, "crc32").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min(F.struct("crc32", "n")).alias("least"), F.sum("n").alias("n"))
    fresh = slim.select(*keys, "least.crc32", F.col("n").alias("__n")).join(target.select(*keys), keys, "left_anti")
    if base is not None:
        same = base.select(*keys, F.col("crc32").alias("crc32")).where("crc32 is not null")
        fresh = fresh.join(same, [*keys, "crc32"], "left_anti")
    wanted = fresh.select(*(F.col(k).alias(f"__{k}") for k in (*keys, "crc32")), "__n")
    found = source.join(wanted, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("crc32").eqNullSafe(F.col("__crc32"))])
    alone = found.where("__n = 1").select(*source.columns)
    return alone.unionByName(found.where("__n > 1").select(*source.columns).dropDuplicates(keys))


def ingest_metrics(source: DataFrame, target: DataFrame, base: DataFrame) -> DataFrame:
    """Rows by outcome, each row once: exists, same_crc, new_in_base or full."""
    keys = ["z", "x", "y"]
    had = target.select(*keys).withColumn("had", F.lit(True))
    old = base.select(*keys, F.col("crc32").alias("old"), F.lit(True).alias("based"))
    rows = source.dropDuplicates(keys).join(had, keys, "left").join(old, keys, "left")
    status = F.when(F.col("had"), "exists").when(F.col("crc32") == F.col("old"), "same_crc").when(F.col("based"), "diff").otherwise("full")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def merge_metrics(tiles: DataFrame, existing: DataFrame, visible: DataFrame) -> DataFrame:
    """Parents of tiles by outcome, each once: skipped (exists), empty (no visible child) or merged."""
    xy = ["x", "y"]
    had = existing.select(*xy).withColumn("had", F.lit(True))
    seen = parents(visible).withColumn("seen", F.lit(True))
    rows = parents(tiles).join(had, xy, "left").join(seen, xy, "left")
    status = F.when(F.col("had"), "skipped").when(F.col("seen"), "merged").otherwise("empty")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def serve(requests: DataFrame, catalog: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (version, z, x, y as strings, if_none_match) with status and etag.

    400: no valid address; 500: unknown version; 404: no such tile; 304: the etag is known; else 200.
    """
    from tessella.functions.tiles import etag, valid_tile, whole_number

    own = requests.withColumns({f"__{c}": whole_number(F.col(c)) for c in "zxy"})
    known = catalog.select(F.col("version").alias("__version")).distinct()
    there = store.select(F.col("version").alias("__v"), F.col("z").alias("__tz"), F.col("x").alias("__tx"), F.col("y").alias("__ty")).distinct()
    rows = own.join(known, F.col("version") == F.col("__version"), "left")
    rows = rows.join(there, (F.col("version") == F.col("__v")) & (F.col("__z") == F.col("__tz")) & (F.col("__x") == F.col("__tx")) & (F.col("__y") == F.col("__ty")), "left")
    tag = etag(F.col("version"), F.col("__z"), F.col("__x"), F.col("__y"))
    good = F.coalesce(valid_tile(F.col("__z"), F.col("__x"), F.col("__y")), F.lit(False))
    status = F.when(~good, 400).when(F.col("__version").isNull(), 500).when(F.col("__v").isNull(), 404).when(F.col("if_none_match") == tag, 304).otherwise(200)
    return rows.select(*requests.columns, status.alias("status"), F.when(status.isin(200, 304), tag).alias("etag"))


ROUTE = r"^/tiles/(v[0-9a-z.]+)/([0-9]+)/([0-9]+)/([0-9]+)\.png$"


def serve_paths(requests: DataFrame, catalog: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (path, if_none_match) with status and etag: serve() of /tiles/version/z/x/y.png; other paths are 404."""
    parts = {name: F.regexp_extract("path", ROUTE, i) for i, name in enumerate(("version", "z", "x", "y"), 1)}
    routed = serve(requests.withColumns(parts), catalog, store)
    known = F.col("path").rlike(ROUTE)
    return routed.select(*requests.columns, F.when(known, F.col("status")).otherwise(404).alias("status"), F.when(known, F.col("etag")).alias("etag"))
