"""Pixel operators: exhaustive quads against plain rules, differences, pyramids, delta merges."""

import itertools
import random
from collections import Counter

import pytest

from tessella.operators import pixels as px
from tessella.model import COLORS, rgb

QUADS = list(itertools.product(range(5), repeat=4))


def majority(q):
    c = Counter(v for v in q if v)
    return max(c, key=lambda v: (c[v], -q.index(v))) if c else 0


def mode(q):
    c = Counter(q)
    return max(c, key=lambda v: (c[v], -q.index(v)))


def weighted(q, block):
    """A running scan: the first colour to reach the largest weight."""
    seen, best, top = Counter(), 0, 0
    for v in q:
        seen[v] += block if v else 1
        if seen[v] > top:
            best, top = v, seen[v]
    return best


def blocks(spark, cells, block):
    """One block per row of a map."""
    rows = [(p % block, n * block + p // block, v) for n, q in enumerate(cells) for p, v in enumerate(q) if v]
    return spark.createDataFrame(rows, "gx long, gy long, color int")


@pytest.mark.parametrize("strategy, rule", [("majority", majority), ("mode", mode), ("weighted", lambda q: weighted(q, 2))])
def test_all_quads(spark, strategy, rule):
    got = {r.gy: r.color for r in px.downsample(blocks(spark, QUADS, 2), strategy).collect()}
    assert all(got.get(n, 0) == rule(q) for n, q in enumerate(QUADS))


def test_rgba_quads(spark):
    wide = [tuple(v * 0x3FFFFFFF for v in q) for q in QUADS]
    rows = [(p % 2, 2 * n + p // 2, v) for n, q in enumerate(wide) for p, v in enumerate(q) if v]
    got = {r.gy: r.color for r in px.downsample(spark.createDataFrame(rows, "gx long, gy long, color long")).collect()}
    assert all(got.get(n, 0) == majority(q) for n, q in enumerate(wide))


@pytest.mark.parametrize("block", [3, 5, 8, 13])
def test_weighted_blocks(spark, block):
    rng = random.Random(block)
    cells = [rng.choices([0, 0, 0, 0, 1, 2], k=block * block) for _ in range(1500)]
    got = {r.gy: r.color for r in px.block_mode(blocks(spark, cells, block), block).collect()}
    assert all(got.get(n, 0) == weighted(q, block) for n, q in enumerate(cells))
    with pytest.raises(ValueError):
        px.block_mode(blocks(spark, cells[:1], 33), 33)


def test_average(spark):
    got = {r.gy: (r.r, r.g, r.b, r.a) for r in px.average(blocks(spark, QUADS, 2)).collect()}
    for n, q in enumerate(QUADS):
        if any(q):
            want = [sum((rgb(v) + (255 if v else 0,))[c] * 257 for v in q) // 4 >> 8 for c in range(4)]
            assert list(got[n]) == want


def world(rng, n, side):
    return {(rng.randrange(side), rng.randrange(side)): rng.randint(1, 4) for _ in range(n)}


def frame(spark, pixels):
    return spark.createDataFrame([(x, y, c) for (x, y), c in pixels.items()], "gx long, gy long, color int")


def plain(df):
    rows = df.collect()
    assert len({(r.gx, r.gy) for r in rows}) == len(rows)
    return {(r.gx, r.gy): r.color for r in rows}


def halved(pixels):
    quads = {}
    for (x, y), c in pixels.items():
        quads.setdefault((x >> 1, y >> 1), [0] * 4)[(x & 1) + 2 * (y & 1)] = c
    return {k: majority(q) for k, q in quads.items()}


def test_diff_and_undiff(spark):
    rng = random.Random(1)
    base, new = world(rng, 300, 24), world(rng, 300, 24)
    b, n = frame(spark, base), frame(spark, new)
    delta = px.diff(b, n)
    assert plain(delta) == {k: v for k, v in new.items() if base.get(k) != v}
    assert plain(px.undiff(b, delta)) == base | new
    assert plain(px.exact_undiff(b, px.diff(b, n, exact=True))) == new
    assert px.diff(b, b).count() == 0 and px.changed_tiles(b, b, 8).count() == 0
    changed = {(r.x, r.y): r.erased for r in px.changed_tiles(b, n, 8).collect()}
    want = Counter((x // 8, y // 8) for x, y in base.keys() - new.keys())
    assert changed.keys() == {(x // 8, y // 8) for x, y in base.keys() | new.keys() if base.get((x, y)) != new.get((x, y))}
    assert all(v == want[k] for k, v in changed.items())


@pytest.mark.parametrize("cut", [None, 0, 3])
def test_pyramid(spark, cut):
    pixels = world(random.Random(2), 500, 64)
    rows = px.pyramid(frame(spark, pixels), 4, shuffle_zoom=cut, side=4).collect()
    now = pixels
    for z in (3, 2, 1, 0):
        now = halved(now)
        assert {(r.gx, r.gy): r.color for r in rows if r.z == z} == now


def test_pyramid_shuffles_twice(spark):
    rows = px.pyramid(frame(spark, world(random.Random(3), 50, 64)), 4, side=4)
    plan = rows.where("z = 2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def simulated(base, base_tiles, base_up, base_up_tiles, delta, delta_tiles, side):
    """Tile by tile."""
    out, tiles = {}, set()
    of = lambda pixels, t: {k: v for k, v in pixels.items() if (k[0] // side, k[1] // side) == t}
    for parent in {(x >> 1, y >> 1) for x, y in delta_tiles}:
        children = [t for t in delta_tiles if (t[0] >> 1, t[1] >> 1) == parent and t in base_tiles]
        if not children:
            continue
        seen = {}
        for t in children:
            seen |= of(base, t) | of(delta, t)
        merged = halved(seen)
        if parent in base_up_tiles:
            old = of(base_up, parent)
            changed = {k for k in merged.keys() | old.keys() if merged.get(k, 0) != old.get(k, 0)}
            if not changed:
                continue
            out |= {k: merged[k] for k in changed if merged.get(k)}
        else:
            out |= merged
        tiles.add(parent)
    return out, tiles


@pytest.mark.parametrize("seed", range(4))
def test_delta_merge_equals_simulation(spark, seed):
    rng = random.Random(seed)
    base, new = world(rng, 60, 32), world(rng, 40, 32)
    new |= {k: v for k, v in base.items() if rng.random() < 0.8}
    side = 4
    tiles_of = lambda p: {(x // side, y // side) for x, y in p}
    delta = {k: v for k, v in new.items() if base.get(k) != v}
    delta_tiles = {(x // side, y // side) for x, y in base.keys() | new.keys() if base.get((x, y)) != new.get((x, y))}
    up = halved(base)
    up_tiles = tiles_of(up) - {next(iter(tiles_of(up)))}  # one parent that base lacks
    up = {k: v for k, v in up.items() if (k[0] // side, k[1] // side) in up_tiles}
    xy = lambda s: spark.createDataFrame(sorted(s), "x int, y int")
    pixels, tiles = px.diff_level(frame(spark, delta), xy(delta_tiles), frame(spark, base), xy(tiles_of(base)), frame(spark, up), xy(up_tiles), side)
    want, want_tiles = simulated(base, tiles_of(base), up, up_tiles, delta, delta_tiles, side)
    assert plain(pixels) == want and {(r.x, r.y) for r in tiles.collect()} == want_tiles


def test_delta_merge_of_new_areas(spark):
    base, new = {(0, 0): 1}, {(0, 0): 1, (9, 9): 2}
    xy = lambda s: spark.createDataFrame(sorted(s), "x int, y int")
    args = (frame(spark, {(9, 9): 2}), xy({(2, 2)}), frame(spark, base), xy({(0, 0)}), frame(spark, {(0, 0): 1}), xy({(0, 0)}), 4)
    assert px.diff_level(*args)[0].count() == 0
    assert plain(px.diff_level(*args, propagate_new=True)[0]) == {(4, 4): 2}
    assert len(new) == 2


def test_latest_and_upsert(spark):
    rows = [(0, 0, 5, 1), (0, 0, 7, 3), (0, 0, 6, 2), (1, 0, 2, 9)]
    assert plain(px.latest(spark.createDataFrame(rows, "gx long, gy long, color int, t int"), ["t"])) == {(0, 0): 7, (1, 0): 2}
    store = frame(spark, {(0, 0): 1, (1, 1): 2})
    assert plain(px.upsert(store, frame(spark, {(1, 1): 9, (5, 5): 3}), ["gx", "gy"])) == {(0, 0): 1, (1, 1): 9, (5, 5): 3}


def test_quantise(spark):
    rows = [(i, 0, *rgb(i), 255) for i in range(1, 64)] + [(0, 1, 255, 255, 255, 0), (1, 1, 0, 0, 0, 3), (2, 1, 1, 1, 1, 1), (3, 1, 9, 9, 9, 255)]
    got = plain(px.quantise(spark.createDataFrame(rows, "gx long, gy long, r int, g int, b int, a int")))
    assert [got[i, 0] for i in range(1, 64)] == list(range(1, 64)) and len(COLORS) == 63
    assert [got[i, 1] for i in range(4)] == [0, 1, 1, 0]


def test_ingest_and_metrics(spark):
    t = lambda *rows: spark.createDataFrame(rows, "z int, x int, y int, crc32 long")
    source, target, base = t((11, 1, 1, 5), (11, 1, 2, 6), (11, 1, 3, 7), (11, 1, 4, 8), (11, 1, 4, 8)), t((11, 1, 1, 0)), t((11, 1, 2, 6), (11, 1, 3, 0), (11, 1, 4, None))
    assert sorted(r.y for r in px.ingest(source, target, base).collect()) == [3, 4]
    assert {r.status: r.n for r in px.ingest_metrics(source, target, base).collect()} == {"exists": 1, "same_crc": 1, "diff": 2}


def test_serve(spark):
    requests = [("v1", "12", "0", "0", None), ("v1", "1", "2", "0", None), ("v1", "x", "0", "0", None), ("v1", "1", "0", "0", None), ("v9", "1", "0", "0", None), ("v1", "1", "1", "1", '"v1-1/1/1"'), ("v1", "1", "1", "1", '"v1-1/1/0"'), ("v1", "99999999999", "0", "0", None)]
    r = spark.createDataFrame(requests, "version string, z string, x string, y string, if_none_match string")
    store = spark.createDataFrame([("v1", 1, 1, 1)], "version string, z int, x int, y int")
    got = {tuple(x)[:5]: x.status for x in px.serve(r, store, store).collect()}
    assert [got[q] for q in requests] == [400, 400, 400, 404, 500, 304, 200, 400]


def test_diff_pyramid_equals_steps(spark):
    """All levels in one relation against the operator of one step, level by level."""
    rng = random.Random(21)
    base = world(rng, 160, 32)
    new = {k: v for k, v in base.items() if rng.random() < 0.9} | world(rng, 60, 32)
    b, n = frame(spark, base), frame(spark, new)
    got = {}
    for r in px.diff_pyramid(b, n, 3, 4, lambda df: df.cache()).collect():
        got.setdefault(r.z, {})[r.gx, r.gy] = r.color
    delta, changed = px.diff(b, n), px.changed_tiles(b, n, 4).select("x", "y")
    for z in (2, 1, 0):
        above = px.downsample(b)
        delta, changed = (df.cache() for df in px.diff_level(delta, changed, b, px.tiles(b, 4), above, px.tiles(above, 4), 4))
        b = above
        assert got.get(z, {}) == plain(delta), z


def test_refresh_rebuilds_ancestors_of_changes_only(spark):
    """One changed tile of many: its ancestors, as far as the change shows; the rest is as it was."""
    rng = random.Random(11)
    old = {(x, y): rng.randint(1, 5) for x in range(64) for y in range(64) if rng.random() < 0.7}
    frame = lambda m: spark.createDataFrame([(x, y, c) for (x, y), c in m.items()], "gx long, gy long, color int")
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    levels = keep(px.pyramid(frame(old), 3, side=8))
    new = old | {(x, y): 9 for x in range(16, 24) for y in range(40, 48)}
    touched = spark.createDataFrame([(2, 5), (0, 0)], "x int, y int")  # the second one is as it was
    pixels, tiles = px.refreshed(frame(new), touched, levels, 3, 8, keep)
    assert {tuple(r) for r in tiles.collect()} == {(2, 1, 2), (1, 0, 1), (0, 0, 0)}
    got = {(r.z, r.gx, r.gy): r.color for r in px.patched(levels, pixels, tiles, 8).collect()}
    assert got == {(r.z, r.gx, r.gy): r.color for r in px.pyramid(frame(new), 3, side=8).collect()}
    pixels, tiles = px.refreshed(frame(old), touched, levels, 3, 8, keep)
    assert tiles.count() == pixels.count() == 0
    gone = {k: v for k, v in old.items() if not (16 <= k[0] < 24 and 40 <= k[1] < 48)}
    pixels, tiles = px.refreshed(frame(gone), touched.limit(1), levels, 3, 8, keep)
    got = {(r.z, r.gx, r.gy): r.color for r in px.patched(levels, pixels, tiles, 8).collect()}
    assert got == {(r.z, r.gx, r.gy): r.color for r in px.pyramid(frame(gone), 3, side=8).collect()}
