"""PNG codec, packed operators, sources, store, whole jobs and streams."""

import io
import lzma
import random
import sqlite3
import struct
import tarfile
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import api
from tessella.functions import png
from tessella.operators import packed
from tessella.operators import pixels as px
from tessella.plans import planner
from tessella.sources import read_tiles, sevenzip, writers
from tessella.sources.store import TileStore
from tessella.streaming import daily
from test_pixels import frame, halved, majority, plain, world


def filtered(rows, filters, step):
    """Rows with their filter bytes, by plain rules."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, filters):
        line = bytearray()
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out, above = out + bytes([kind]) + line, row
    return out


def whole(mode, depth, width, height, body, extra=b"", interlaced=0):
    head = struct.pack(">IIBBBBB", width, height, depth, mode, 0, 0, interlaced)
    return png.SIGNATURE + part(b"IHDR", head) + extra + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def file(mode, depth, rows, filters, extra=b"", width=None):
    """A PNG from raw sample bytes, filtered here with its own plain rules."""
    channels = png.CHANNELS[mode]
    body = filtered(rows, filters, max(1, channels * depth // 8))
    return whole(mode, depth, width or len(rows[0]) * 8 // (channels * depth), len(rows), body, extra)


def part(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 64, (33, 57), dtype=np.uint8)
    pixels, table = png.decode(png.encode(a))
    assert (pixels == a).all() and table[0, 3] == 0 and (png.quantised(png.encode(a)) == a).all()
    for mode, n in png.CHANNELS.items():
        rows = [rng.integers(0, 256, 9 * n, dtype=np.uint8).tobytes() for _ in range(10)]
        own, _ = png.decode(file(mode, 8, rows, [0, 1, 2, 3, 4] * 2, part(b"PLTE", bytes(768)) if mode == 3 else b""))
        want = np.frombuffer(b"".join(rows), np.uint8).reshape(10, 9, n)
        if mode == 3:
            assert (own == want[:, :, 0]).all()
        else:
            assert (own[:, :, :3] == (want[:, :, :3] if n > 2 else want[:, :, :1])).all()
            assert (own[:, :, 3] == (want[:, :, -1] if n in (2, 4) else 255)).all()


def test_png_depths_and_transparency():
    palette = part(b"PLTE", b"".join(bytes(c) for c in png.PALETTE_RGB[:16]))
    own, table = png.decode(file(3, 4, [bytes([0x12, 0x3F])], [0], palette + part(b"tRNS", b"\0\x80"), width=4))
    assert own.tolist() == [[1, 2, 3, 15]] and table[:3, 3].tolist() == [0, 128, 255]
    gray, _ = png.decode(file(0, 1, [bytes([0b10100000])], [0], part(b"tRNS", b"\0\x01"), width=3))
    assert gray[0, :, 0].tolist() == [255, 0, 255] and gray[0, :, 3].tolist() == [0, 255, 0]
    deep, _ = png.decode(file(2, 16, [bytes([1, 9, 2, 9, 3, 9])], [0]))
    assert deep[0, 0].tolist() == [1, 2, 3, 255]
    rgba = file(6, 8, [bytes([*png.PALETTE_RGB[7], 255, 1, 2, 3, 255, 9, 9, 9, 0, 0, 0, 0, 5])], [0])
    assert png.quantised(rgba).tolist() == [[7, 0, 0, 1]]
    with pytest.raises(ValueError):
        png.decode(b"nothing")


def seven_passes(samples):
    """The pixels of each pass: from a table of which pass the places of an 8 x 8 field are in."""
    field = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]
    for number in "1234567":
        rows = [[samples[y, x] for x in range(samples.shape[1]) if field[y % 8][x % 8] == number] for y in range(samples.shape[0])]
        yield [r for r in rows if r]


@pytest.mark.parametrize("mode, depths", [(0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))])
def test_png_interlaced(mode, depths):
    """Interlaced images of all types are read as the same ones in one pass; only paletted ones as paletted."""
    rng = np.random.default_rng(mode)
    n = png.CHANNELS[mode]
    for depth in depths:
        extra = part(b"PLTE", bytes(rng.integers(0, 256, 3 << depth, dtype=np.uint8))) if mode == 3 else b""

        def line(pixels):
            bits = "".join(f"{v:0{depth}b}" for p in pixels for v in p)
            return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

        for height, width in ((1, 1), (2, 3), (5, 4), (8, 8), (13, 19), (1, 9)):
            samples = rng.integers(0, 1 << depth, (height, width, n))
            step = max(1, n * depth // 8)
            of = lambda rows: filtered([line(r) for r in rows], rng.integers(0, 5, len(rows)).tolist(), step) if rows else b""
            plain_body, body = of(list(samples)), b"".join(of(p) for p in seven_passes(samples))
            one, other = whole(mode, depth, width, height, plain_body, extra), whole(mode, depth, width, height, body, extra, 1)
            assert (png.decode(one)[0] == png.decode(other)[0]).all() and (png.quantised(one) == png.quantised(other)).all()
            if mode == 3:
                assert (png.decode_paletted(other)[0] == samples[:, :, 0]).all()
            else:
                with pytest.raises(ValueError, match="not paletted"):
                    png.decode_paletted(other)
            for bad in (whole(mode, depth, width, height, body[:-1], extra, 1), whole(mode, depth, width, height, body + b"x", extra, 1), whole(mode, depth, width, height, body, extra, 2)):
                with pytest.raises(ValueError):
                    png.decode(bad)


def test_numpy_majority():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (40, 60), dtype=np.uint8)
    got = packed.majority(a)
    assert all(got[y, x] == majority(a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].ravel().tolist()) for y in range(20) for x in range(30))
    assert packed.majority(np.ones((5, 7), np.uint8)).shape == (2, 3)


def test_packed_equals_pixels(spark):
    rng = random.Random(3)
    base, new = world(rng, 200, 32), world(rng, 120, 32)
    new |= {k: v for k, v in base.items() if rng.random() < 0.9}
    b, n = frame(spark, base), frame(spark, new)
    bt, nt = packed.to_tiles(b, 3, 4), packed.to_tiles(n, 3, 4)
    assert plain(packed.to_pixels(nt, 4).drop("z")) == new
    assert plain(packed.to_pixels(packed.merge_level(nt, 2), 4).drop("z")) == halved(new)
    delta = packed.ingest_tiles(nt, nt.limit(0), bt)
    whole = {k for k in new if (k[0] // 4, k[1] // 4) not in {(x // 4, y // 4) for x, y in base}}
    assert plain(packed.to_pixels(delta, 4).drop("z")) == {k: v for k, v in new.items() if base.get(k) != v or k in whole}
    back = bt.join(delta.select("z", "x", "y", F.col("data").alias("d")), ["z", "x", "y"]).select("z", "x", "y", packed.tile_undiff(F.col("data"), F.col("d")).alias("data"))
    assert packed.to_pixels(back, 4).count() > 0
    stored = delta.select("z", "x", "y", "crc32").join(nt.select("z", "x", "y", F.col("crc32").alias("own")), ["z", "x", "y"])
    assert stored.where("crc32 <> own").count() == 0


def image(seed):
    return png.encode(np.random.default_rng(seed).integers(0, 64, (8, 8), dtype=np.uint8))


def test_sources(spark, tmp_path):
    entries = {"arc/1036/704.png": (1036, 704), "a/b/c/5/6.png": (5, 6), "arc/5/7": (5, 7), "arc/5/readme.txt": None, "arc/abc/1.png": None, "top.png": None}
    folder = tmp_path / "folder"
    for i, name in enumerate(entries):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(image(i))
    want = {v: image(i) for i, v in enumerate(entries.values()) if v}
    archive = tmp_path / "a.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(folder, "root")
        link = tarfile.TarInfo("arc/9/9.png")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        tar.addfile(link)
        big = tarfile.TarInfo("arc/8/8.png")
        big.size = (10 << 20) + 1
        tar.addfile(big, io.BytesIO(bytes(big.size)))
    db = tmp_path / "t.db"
    with sqlite3.connect(db) as c:
        c.execute("create table tiles(z, x, y, crc32, data)")
        c.executemany("insert into tiles values (11, ?, ?, 0, ?)", [(x, y, d) for (x, y), d in want.items()])
        c.execute("insert into tiles values (10, 1, 1, 0, x'00')")
    for path in (folder, archive, db):
        rows = read_tiles(spark, str(path)).collect()
        assert {(r.x, r.y): bytes(r.data) for r in rows} == want and len(rows) == len(want), path
        assert all(r.z == 11 and r.crc32 == zlib.crc32(r.data) for r in rows)
    for path in (folder, archive):
        with pytest.raises(Exception, match="not a tile"):
            read_tiles(spark, str(path), mode="FAILFAST").collect()
    (tmp_path / "cut.tar.gz").write_bytes(archive.read_bytes()[:200])
    with pytest.raises(Exception, match="ReadError|EOFError"):
        read_tiles(spark, str(tmp_path / "cut.tar.gz")).collect()


def test_rejects(spark, tmp_path):
    """Every entry is a tile or a reject with a reason; a damaged archive gives what comes before the damage."""
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, data in (("t/1/2.png", image(1)), ("t/readme.txt", b"x"), ("t/3/4.png", b"no image"), ("t/5/6.png", bytes((10 << 20) + 1))):
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
        entry = tarfile.TarInfo("t/7/8.png")
        entry.type = tarfile.FIFOTYPE
        tar.addfile(entry)
    whole = tmp_path / "whole.tar"
    with tarfile.open(whole, "w") as tar:
        for i in range(3):
            entry = tarfile.TarInfo(f"t/{i}/0.png")
            entry.size = 3000
            tar.addfile(entry, io.BytesIO(bytes(3000)))
    (tmp_path / "cut.tar").write_bytes(whole.read_bytes()[:5000])
    with sqlite3.connect(tmp_path / "t.db") as c:
        c.execute("create table tiles(x, y, data)")
        c.executemany("insert into tiles values (?, ?, ?)", [(1, 1, image(2)), (1, 2, None), ("a", 3, image(3))])
    (tmp_path / "bad.db").write_bytes(b"no database" * 500)
    store = TileStore(spark, str(tmp_path / "store"))
    got = {}
    for i, name in enumerate(("a.tar.gz", "cut.tar", "t.db", "bad.db")):
        out = str(tmp_path / f"rejects{i}")
        found = api.ingest(spark, str(tmp_path / name), store, f"v{i}", rejects=out)
        got[name] = (found["tiles"], sorted((r.path.rpartition("problem")[2].rpartition("-")[2], r.reason) for r in spark.read.schema("path string, reason string").parquet(out).collect()))
    assert got["a.tar.gz"] == (1, [("t/3/4.png", "image"), ("t/5/6.png", "size"), ("t/7/8.png", "kind"), ("t/readme.txt", "name")])
    tiles, (damaged, *rest) = got["cut.tar"]
    assert tiles == 0 and damaged[1] == "damaged: ReadError" and [r[1] for r in rest] == ["image"]
    assert got["t.db"] == (1, [("1/2", "data"), ("a/3", "name")])
    assert got["bad.db"][0] == 0 and got["bad.db"][1][0][1] == "damaged: DatabaseError"
    (tmp_path / "f" / "1").mkdir(parents=True)
    (tmp_path / "f" / "1" / "2.png").write_bytes(image(4))
    (tmp_path / "f" / "1" / "x.txt").write_bytes(b"x")
    rows = read_tiles(spark, str(tmp_path / "f"), "REJECTS").collect()
    assert sorted((r.path.rpartition("/")[2], r.x, r.reason) for r in rows) == [("2.png", 1, None), ("x.txt", None, "name")]


def test_conditions_reach_the_archives(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan

    from tessella.sources import archives

    tiles = spark.createDataFrame([(11, i % 9, i, 0, image(i)) for i in range(60)], "z int, x int, y int, crc32 long, data binary").repartition(3)
    want = sorted((i % 9, i) for i in range(60) if i % 9 == 4 and i < 40)
    seen = []
    real = tarfile.TarFile.extractfile
    monkeypatch.setattr(archives.tarfile.TarFile, "extractfile", lambda *a: seen.append(1) or real(*a))
    filters = [EqualTo(("x",), 4), LessThan(("y",), 40), IsNotNull(("x",)), In(("z",), (11, 12))]
    for kind, make in (("db", lambda f: archives.SqliteReader(f, 3, "PERMISSIVE")), ("tar.gz", lambda f: archives.TarReader(f, "PERMISSIVE"))):
        files = writers.write_archives(tiles, str(tmp_path / kind), kind)
        reader = make(files)
        assert [type(f) for f in reader.pushFilters(filters)] == [IsNotNull]
        seen.clear()
        assert sorted(r[1:3] for p in reader.partitions() for r in reader.read(p)) == want
        assert len(seen) == (len(want) if kind == "tar.gz" else 0)
        rows = read_tiles(spark, ",".join(files)).where("x = 4 and y < 40 and z in (11, 12)")
        assert sorted((r.x, r.y) for r in rows.collect()) == want
        assert read_tiles(spark, ",".join(files)).where("z = 3").count() == 0
    reader = archives.SqliteReader(files, 3, "PERMISSIVE")
    assert list(reader.pushFilters([EqualTo(("z",), 3)])) == [] and reader.partitions() == []


def test_sqlite_ranges(spark, tmp_path):
    """Every tile once, however the rows are divided; a dense column is, too."""
    with sqlite3.connect(tmp_path / "t.db") as c:
        c.execute("create table tiles(x, y, data)")
        c.executemany("insert into tiles values (?, ?, x'00')", [(5, y) for y in range(50)] + [(x, 0) for x in range(6, 9)])
    assert read_tiles(spark, str(tmp_path / "t.db")).count() == 53  # and the source is registered
    for ranges in (1, 4, 100):
        rows = spark.read.format("tessella_sqlite").option("ranges", ranges).load(str(tmp_path / "t.db"))
        assert rows.count() == 53 and rows.distinct().count() == 53
    parts = spark.read.format("tessella_sqlite").option("ranges", 4).load(str(tmp_path / "t.db")).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in parts) == [13, 13, 13, 14]


def seven_zip(spark, path, files, method):
    """Written by another implementation, which comes with Spark."""
    jvm = spark._jvm
    base = "org.apache.commons.compress.archivers.sevenz"
    out = getattr(jvm, f"{base}.SevenZOutputFile")(jvm.java.io.File(str(path)))
    out.setContentCompression(getattr(getattr(jvm, f"{base}.SevenZMethod"), method))
    for name, data in files.items():
        entry = getattr(jvm, f"{base}.SevenZArchiveEntry")()
        entry.setName(name)
        entry.setDirectory(data is None)
        out.putArchiveEntry(entry)
        if data:
            out.write(bytearray(data))
        out.closeArchiveEntry()
    out.close()


@pytest.mark.parametrize("method", ["COPY", "LZMA", "LZMA2", "DEFLATE", "BZIP2"])
def test_seven_zip(spark, tmp_path, method):
    files = {"arc": None, "arc/1036/704.png": image(1), "a/b/5/6.png": image(2), "arc/5/7": bytes(3_000_000), "arc/5/readme.txt": b"x", "arc/9/9.png": b""}
    path = tmp_path / "a.7z"
    seven_zip(spark, path, files, method)
    rows = {(r.x, r.y): bytes(r.data) for r in read_tiles(spark, str(path)).collect()}
    assert rows == {(1036, 704): image(1), (5, 6): image(2), (5, 7): bytes(3_000_000)}
    with pytest.raises(Exception, match="not a tile"):
        read_tiles(spark, str(path), mode="FAILFAST").collect()
    data = bytearray(path.read_bytes())
    data[60] ^= 255
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksum|rror|ends inside"):
        read_tiles(spark, str(path)).collect()


def test_solid_seven_zip(tmp_path):
    """A block with several files and a packed header, put together here."""
    number = lambda n: bytes([n]) if n < 128 else bytes([0x80 | n >> 8, n & 255])
    files = {"x/1/2.png": b"one", "x/3/4.png": b"three" * 20}
    whole, names = b"".join(files.values()), "".join(n + "\0" for n in files).encode("utf-16-le")
    filters = [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]
    pack = lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=filters)
    streams = lambda at, packed, size: bytes([6]) + number(at) + b"\1\x09" + number(packed) + b"\0\x07\x0b\1\0\1\x21\x21\1\x0a\x0c" + number(size) + b"\0"
    body = pack(whole)
    crcs = b"".join(struct.pack("<I", zlib.crc32(d)) for d in files.values())
    header = b"\1\4" + streams(0, len(body), len(whole)) + b"\x08\x0d\2\x09" + number(3) + b"\x0a\1" + crcs + b"\0\0" + b"\5\2\x11" + number(len(names) + 1) + b"\0" + names + b"\0\0"
    packed_header = pack(header)
    coded = b"\x17" + streams(len(body), len(packed_header), len(header)) + b"\0"
    start = struct.pack("<QQI", len(body) + len(packed_header), len(coded), zlib.crc32(coded))
    data = sevenzip.MAGIC + b"\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + packed_header + coded
    stream = io.BytesIO(data)
    (block,) = sevenzip.contents(stream)
    assert [(n, d) for n, _, d in sevenzip.entries(stream, block)] == list(files.items())
    with pytest.raises(ValueError, match="damaged"):
        sevenzip.contents(io.BytesIO(data[:-1] + b"\xff"))


def test_store(spark, tmp_path):
    store = TileStore(spark, str(tmp_path / "store"))
    t = lambda *rows: spark.createDataFrame(rows, "z int, x int, y int, crc32 long, data binary")
    store.put(t((11, 1, 2, 7, b"a"), (10, 0, 1, 8, b"b")), "v1")
    store.put(t((11, 1, 2, 9, b"c"), (11, 1, 3, None, b"d")), "v1")
    store.put(t((11, 5, 5, 0, b"e")), "v1.024", auto_crc=True)
    assert bytes(store.get("v1", 11, 1, 2).first().data) == b"c" and store.get("v1", 11, 9, 9).count() == 0
    assert store.stat("v1", 10, 0, 1).first().crc32 == 8 and store.stat("v1", 11, 1, 3).first().crc32 is None
    assert [tuple(store.status("v1", *at).first()) for at in ((10, 0, 1), (11, 1, 3), (11, 9, 9))] == [(True, 8, None), (True, None, "checksum"), (False, None, None)]
    assert store.stat("v1.024", 11, 5, 5).first().crc32 == zlib.crc32(b"e")
    assert sorted(tuple(r) for r in store.addresses("v1", 11).collect()) == [(1, 2), (1, 3)]
    assert [tuple(r) for r in store.catalog().collect()] == [("v1", 3), ("v1.024", 1)]
    store.set_crc(spark.createDataFrame([(11, 1, 3, 77)], "z int, x int, y int, crc32 long"), "v1")
    assert store.stat("v1", 11, 1, 3).first().crc32 == 77 and store.tiles().count() == 4
    plan = store.get("v1", 11, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "ReadSchema: struct<x:int,y:int,data:binary>" in plan
    with pytest.raises(PermissionError):
        TileStore(spark, store.path, read_only=True).put(t((11, 1, 1, 1, b"x")), "v1")


def test_snapshots(spark, tmp_path, monkeypatch):
    """Readers see an upsert whole or not at all; a draft when it is published; what died leaves no trace."""
    store = TileStore(spark, str(tmp_path / "store"))
    t = lambda *rows: spark.createDataFrame([(z, x, y, c, d) for z, x, y, c, d in rows], "z int, x int, y int, crc32 long, data binary")
    rows = lambda s: sorted((r.version, r.z, r.x, r.y, bytes(r.data)) for r in s.tiles().collect())
    store.put(t((11, 1, 1, 1, b"a"), (11, 900, 1, 2, b"b")), "v1")
    seen = store.tiles()
    store.put(t((11, 1, 2, 3, b"c"), (11, 1, 1, 9, b"z"), (11, 1, 1, 4, b"d")), "v1")  # of two the least checksum
    first = [("v1", 11, 1, 1, b"d"), ("v1", 11, 1, 2, b"c"), ("v1", 11, 900, 1, b"b")]
    assert rows(store) == first and seen.count() == 2
    draft = store.begin()
    draft.put(t((11, 1, 1, 5, b"e")), "v1")
    draft.put(t((11, 7, 7, 6, b"f")), "v2")
    assert rows(store) == first and len(rows(draft)) == 4
    draft.publish("job")
    assert rows(store) == rows(draft) and store.head()["jobs"] == ["job"]
    late = store.begin()
    store.put(t((11, 2, 2, 1, b"g")), "v2")
    late.put(t((11, 3, 3, 1, b"h")), "v2")
    with pytest.raises(RuntimeError, match="another writer"):
        late.publish()
    before = rows(store)
    monkeypatch.setattr(TileStore, "_add", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.put(t((11, 1, 1, 7, b"x")), "v1")
    monkeypatch.undo()
    assert rows(store) == before == rows(TileStore(spark, store.path))
    assert store.vacuum() >= 2 and rows(store) == before and len(store._numbers()) == 1
    store.put(t().limit(0), "v1")
    assert rows(store) == before


def test_functions_for_sql(spark):
    from tessella.functions import udtf

    udtf.register(spark)
    one, two = image(1), image(2)
    spark.createDataFrame([(1, one, two), (2, None, two), (3, b"unreadable", two)], "i int, a binary, b binary").createOrReplaceTempView("pairs")
    got = spark.sql("select i, p.* from pairs, lateral tile_decode(a) p").collect()
    want = png.quantised(one)
    assert {(r.px, r.py): r.color for r in got} == {(x, y): int(want[y, x]) for y, x in zip(*np.nonzero(want))} and {r.i for r in got} == {1}
    rows = spark.sql("select i, tile_readable(a) as readable, tile_undiff(a, tile_diff(a, b).data) as new from pairs").collect()
    assert [r.readable for r in sorted(rows)] == [True, False, False]
    new = png.quantised(bytes(sorted(rows)[0].new))
    assert (new[png.quantised(two) != 0] == png.quantised(two)[png.quantised(two) != 0]).all()


def test_restart(spark, tmp_path, monkeypatch):
    """A plan that dies within a job, or between two, ends in the same store when it is run again."""
    rng = random.Random(6)
    maps = {datetime(2025, 1, d): world(rng, 12, 16) for d in (7, 8)}
    for day, pixels in maps.items():
        for r in packed.to_tiles(frame(spark, pixels), 11, 8).collect():
            path = tmp_path / str(day.day) / str(r.x) / f"{r.y}.png"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(r.data)
    archives = spark.createDataFrame([(d, 1, 24 * (d.day - 7)) for d in maps], "dt timestamp, major int, minor int")
    jobs = planner.plan(archives, planner.done(spark.createDataFrame([], "name string, is_dir boolean, ord long")))
    where = {d: str(tmp_path / str(d.day)) for d in maps}
    whole, store = (TileStore(spark, str(tmp_path / n)) for n in ("whole", "store"))
    rows = lambda s: sorted((r.version, r.z, r.x, r.y, r.crc32, bytes(r.data)) for r in s.tiles().collect())
    full = api.build_pyramid
    real = lambda draft, version, base: full(draft, version, base, first=1)  # noqa: E731  few levels are enough here
    monkeypatch.setattr(api, "build_pyramid", real)
    assert api.run_plan(spark, jobs, where, whole) == 2

    def dies(draft, *rest):
        real(draft, *rest)
        raise KeyboardInterrupt  # all is written, nothing published

    monkeypatch.setattr(api, "build_pyramid", dies)
    with pytest.raises(KeyboardInterrupt):
        api.run_plan(spark, jobs, where, store)
    assert [r.version for r in store.catalog().collect()] == [] and store.head()["jobs"] == []
    monkeypatch.setattr(api, "build_pyramid", real)
    assert api.run_plan(spark, jobs.where("not is_diff"), where, store) == 1
    assert len(store.head()["jobs"]) == 1 and api.run_plan(spark, jobs, where, store) == 1 and api.run_plan(spark, jobs, where, store) == 0
    assert rows(store) == rows(whole)


def test_update_rebuilds_ancestors_only(spark, tmp_path):
    """Equal to a full rebuild, as a base and as a delta; a change that doesn't show above stops there."""
    rng = random.Random(8)
    base, new = world(rng, 60, 32), None
    new = base | world(rng, 6, 32)
    store = TileStore(spark, str(tmp_path / "store"))
    z = 3
    tiles = lambda pixels: packed.to_tiles(frame(spark, pixels), z, 4)
    images = lambda s, v: {(r.z, r.x, r.y): bytes(r.data) for r in s.tiles(v).collect()}
    for version, pixels in (("old", base), ("v1", base), ("full", new)):
        store.put(tiles(pixels), version)
        for level in range(z - 1, -1, -1):
            store.put(packed.merge_level(store.tiles(version), level), version)
    changed = {k[0] // 4 * 100 + k[1] // 4 for k in new if base.get(k) != new[k]}
    some = tiles(new).where((F.col("x") * 100 + F.col("y")).isin(*changed))
    n = api.update(store, some, "v1", leaf=z)
    assert images(store, "v1") == images(store, "full") and 0 < n <= 3 * len(changed)
    assert api.update(store, some, "v1", leaf=z) == 0
    delta = packed.ingest_tiles(tiles(new), store.tiles("none"), store.tiles("old"))
    store.put(delta, "d")
    for level in range(z - 1, -1, -1):
        store.put(packed.merge_level(store.tiles("d"), level, store.tiles("old")), "d")
    want = packed.to_pixels(store.tiles("d"), 4).collect()
    first = delta.orderBy("x", "y").limit(2)
    store.put(delta.join(first, ["x", "y"], "left_anti"), "e")
    for level in range(z - 1, -1, -1):
        store.put(packed.merge_level(store.tiles("e"), level, store.tiles("old")), "e")
    api.update(store, first, "e", base="old", leaf=z)
    assert sorted(want) == sorted(packed.to_pixels(store.tiles("e"), 4).collect())


def test_jobs(spark, tmp_path):
    rng = random.Random(4)
    base, new = world(rng, 40, 16), world(rng, 30, 16)
    new |= base
    for name, pixels in (("one", base), ("two", new)):
        for r in packed.to_tiles(frame(spark, pixels), 11, 8).collect():
            path = tmp_path / name / str(r.x) / f"{r.y}.png"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(r.data)
    store = TileStore(spark, str(tmp_path / "store"))
    api.ingest(spark, str(tmp_path / "one"), store, "v1")
    api.build_pyramid(store, "v1", first=10)
    before = store.tiles().count()
    top = plain(packed.to_pixels(store.tiles("v1", 9), 8).drop("z"))
    assert top == halved(halved(base)) and store.tiles("v1", 0).count() == 1
    api.build_pyramid(store, "v1", first=10)
    assert store.tiles().count() == before
    api.ingest(spark, str(tmp_path / "two"), store, "v1.024", "v1")
    api.build_pyramid(store, "v1.024", "v1", first=10)
    delta = plain(packed.to_pixels(store.tiles("v1.024", 11), 8).drop("z"))
    assert delta == {k: v for k, v in new.items() if base.get(k) != v}
    with pytest.raises(ValueError):
        api.build_pyramid(store, "v1", first=11)


def test_run_plan(spark, tmp_path):
    """A base and two diffs, in time order, each with its pyramid."""
    rng = random.Random(5)
    maps, now = {}, {}
    for day in (7, 8, 9):
        now = now | world(rng, 25, 16)
        maps[datetime(2025, 1, day)] = now
        for r in packed.to_tiles(frame(spark, now), 11, 8).collect():
            path = tmp_path / str(day) / str(r.x) / f"{r.y}.png"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(r.data)
    archives = spark.createDataFrame([(d, 1, 24 * (d.day - 7)) for d in maps], "dt timestamp, major int, minor int")
    jobs = planner.plan(archives, planner.done(spark.createDataFrame([], "name string, is_dir boolean, ord long")))
    store = TileStore(spark, str(tmp_path / "store"))
    assert api.run_plan(spark, jobs, {d: str(tmp_path / str(d.day)) for d in maps}, store) == 3
    assert [r.version for r in store.catalog().collect()] == ["v1", "v1.024", "v1.048"]
    first = maps[datetime(2025, 1, 7)]
    for version, day in (("v1.024", 8), ("v1.048", 9)):
        delta = plain(packed.to_pixels(store.tiles(version, 11), 8).drop("z"))
        assert delta == {k: v for k, v in maps[datetime(2025, 1, day)].items() if first.get(k) != v}
    assert plain(packed.to_pixels(store.tiles("v1", 10), 8).drop("z")) == halved(first) and store.tiles("v1", 0).count() == 1


def test_children_of_other_sizes(spark):
    """A parent whose children differ in size fails alone, and is counted."""
    size = lambda n, seed: png.encode(np.random.default_rng(seed).integers(1, 64, (n, n), dtype=np.uint8))
    rows = [(3, 0, 0, size(8, 1)), (3, 1, 0, size(4, 2)), (3, 2, 2, size(8, 3)), (3, 3, 3, size(8, 4)), (3, 4, 0, b"unreadable"), (3, 5, 0, size(4, 5))]
    tiles = spark.createDataFrame([(z, x, y, 0, d) for z, x, y, d in rows], "z int, x int, y int, crc32 long, data binary")
    assert sorted((r.x, r.y) for r in packed.merge_level(tiles, 2).collect()) == [(1, 1), (2, 0)]
    assert [(r.x, r.y) for r in packed.merge_failures(tiles, 2).collect()] == [(0, 0)]


def test_ingest_takes_one_of_repeated_keys(spark):
    rows = [(1, 0, 0, 5, b"b"), (1, 0, 0, 3, b"a"), (1, 0, 0, 3, b"a"), (1, 1, 0, None, b"n"), (1, 2, 0, 7, b"c"), (1, 3, 0, 8, b"d")]
    source = spark.createDataFrame(rows, "z int, x int, y int, crc32 long, data binary")
    target, base = source.where("x = 3"), source.where("x = 2")
    got = sorted((r.x, r.crc32 or 0, bytes(r.data)) for r in px.ingest(source, target, base).collect())
    assert got == [(0, 3, b"a"), (1, 0, b"n")]
    assert px.ingest(source, target).count() == 3 and px.ingest(source.limit(0), target, base).count() == 0


def test_writers_and_directories(spark, tmp_path):
    tiles = spark.createDataFrame([(11, i, i * 2, 0, image(i)) for i in range(9)], "z int, x int, y int, crc32 long, data binary").repartition(3)
    want = {(i, i * 2): image(i) for i in range(9)}
    assert writers.write_folder(tiles, str(tmp_path / "folder.db")) == 9  # a directory, whatever its name
    for path in (str(tmp_path / "folder.db"), ",".join(writers.write_archives(tiles, str(tmp_path / "t"), "tar.gz"))):
        assert {(r.x, r.y): bytes(r.data) for r in read_tiles(spark, path).collect()} == want
    found = [r for f in writers.write_archives(tiles, str(tmp_path / "s"), "db") for r in read_tiles(spark, f).collect()]
    assert {(r.x, r.y): bytes(r.data) for r in found} == want
    assert writers.write_archives(tiles.limit(0), str(tmp_path / "e"), "db") == []


def test_streams(spark, tmp_path):
    tiles = spark.createDataFrame([(11, i, 0, i, b"x") for i in range(6)], "z int, x int, y int, crc32 long, data binary")
    tiles.repartition(3).write.parquet(str(tmp_path / "in"))
    store = TileStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(tiles.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    daily.tile_stream(stream, store, "v1", str(tmp_path / "c1")).awaitTermination()
    assert store.tiles("v1", 11).count() == 6
    writes = spark.createDataFrame([(i % 4, 0, i, i) for i in range(40)], "gx long, gy long, color int, t int")
    writes.repartition(4).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    daily.pixel_stream(stream, ["t"], str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert plain(daily.current(spark, str(tmp_path / "out"), ["t"])) == plain(px.latest(writes, ["t"]))
    days = spark.createDataFrame([("2025-01-01 01:00:00",), ("2025-01-01 05:00:00",), ("2025-01-02 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("dt"))
    days.coalesce(1).write.parquet(str(tmp_path / "d"))
    first = daily.first_of_day(spark.readStream.schema(days.schema).parquet(str(tmp_path / "d")))
    first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 2


def test_latest_preview(spark):
    top, below = image(1), image(2)
    tiles = spark.createDataFrame([("v2", 0, 0, 0, top), ("v2", 1, 0, 0, below), ("v10", 1, 0, 0, top)], "version string, z int, x int, y int, data binary")
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "version string")
    made = lambda catalog, background: [(r.version, r.status, r.data and bytes(r.data)) for r in packed.latest_preview(catalog, tiles, background).collect()]
    (version, status, data), = made(names("v1.024", "v2", "v2.048"), below)
    a, b = png.quantised(top), png.quantised(below)
    assert (version, status) == ("v2", "overlaid") and (png.quantised(data) == np.where(a == 0, b, a)).all()
    small = png.encode(np.ones((4, 4), np.uint8))
    assert made(names("v2"), None) == [("v2", "no background", top)] and made(names("v2"), small) == [("v2", "other size", top)]
    assert made(names("v10.024", "v2"), below) == [("v10", "no tile", None)] and made(names().limit(0), below) == []
