"""Versions, names and plans: the published scenarios' data and the odd cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import tiles as tf
from tessella.plans import planner

DONE = ["v0_2025-01-01T01.db", "v0.024_2025-01-02T02.db", "v0.048_2025-01-03T03.db", "tmp", "something.png", "v1.024_2025-01-08T02.db", "v1.048_2025-01-09T03.db", "v1_2025-01-07T01.db", "v1_2025-01-07H01.db", "vx_2025-01-07T01.db"]
ARCHIVES = [("2025-01-09 00", 1, 48), ("2025-01-08 12", 1, 36), ("2025-01-08 00", 1, 24), ("2025-01-07 12", 1, 12), ("2025-01-07 00", 1, 0), ("2025-01-03 00", 0, 48), ("2025-01-02 12", 0, 36), ("2025-01-02 00", 0, 24), ("2025-01-01 12", 0, 12), ("2025-01-01 00", 0, 0)]


def done(spark, names):
    return planner.done(spark.createDataFrame([(n, n == "tmp", i) for i, n in enumerate(names)], "name string, is_dir boolean, ord int"))


def archives(spark):
    rows = [(datetime.strptime(d, "%Y-%m-%d %H"), a, b) for d, a, b in ARCHIVES]
    return spark.createDataFrame(rows, "dt timestamp, major int, minor int")


def test_versions(spark):
    rows = [("2025-01-01 00:00:00", "v0.000"), ("2025-01-06 00:00:00", "v0.120"), ("2025-01-07 00:00:00", "v0.144"), ("2025-01-08 00:00:00", "v1.000"), ("2024-12-31 23:30:00", "v0.000"), ("2024-12-24 22:00:00", "v-1.-02")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", tf.format_version(tf.version_of(F.col("t").cast("timestamp"))))
    assert all(r.got == r.want for r in df.collect())
    rows = [("v1", (1, 0, True)), ("1.024", (1, 24, False)), ("v12ab", (12, 0, True)), ("v1.2.3", None), ("vx", None), ("v1.", None), ("", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", tf.parse_version(F.col("t")).alias("v"))
    assert {r.t: r.v and tuple(r.v) for r in df.collect()} == dict(rows)


def test_archive_time(spark):
    rows = [("full/full_2026-06-03T22-11-00Z.db", "2026-06-03 22:11:00"), ("2026-06-03T22-11-00Z", "2026-06-03 22:11:00"), ("full/full_2026-06-03.db", None), ("a/full_2026-06-03T22-11.db", None), ("x_2026-13-03T22-11-00Z.db", None)]
    df = spark.createDataFrame(rows, "p string, want string").select("want", tf.archive_time(F.col("p")).cast("string").alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_done_summary(spark):
    rows = done(spark, DONE)
    assert rows.count() == 6 and planner.done_days(rows).count() == 6
    assert planner.done_latest(rows).first().dt == datetime(2025, 1, 9, 3)
    by = {r.major: (r.base, r.diffs) for r in planner.done_by_major(rows).collect()}
    assert by == {0: (DONE[0], DONE[1:3]), 1: (DONE[7], DONE[5:7])}


def test_done_as_rows(spark):
    rows = done(spark, DONE + [f"v2.{i % 168:03d}_2025-01-{15 + i % 7}T{i % 24:02d}.db" for i in range(500)] + ["v2_2025-01-15T00.db", "v2_2025-01-15T01.db"]).repartition(5)
    want = {r.major: (r.base, r.diffs) for r in planner.done_by_major(rows).collect()}
    assert {r.major: r.base for r in planner.done_bases(rows).collect()} == {k: b for k, (b, _) in want.items()}
    assert sorted(map(tuple, planner.done_diffs(rows).collect())) == sorted((k, i, d) for k, (_, diffs) in want.items() for i, d in enumerate(diffs, 1))


def test_plan(spark):
    jobs = planner.plan(archives(spark), done(spark, DONE[:3])).orderBy("dt").collect()
    assert [(j.dt.day, j.is_diff, j.base) for j in jobs] == [(7, False, None), (8, True, "v1_2025-01-07T00.db"), (9, True, "v1_2025-01-07T00.db")]
    assert [j.name for j in jobs] == ["v1_2025-01-07T00.db", "v1.024_2025-01-08T00.db", "v1.048_2025-01-09T00.db"]
    jobs = planner.plan(archives(spark), done(spark, ["v1_2025-01-07T01.db"])).orderBy("dt").collect()
    assert [j.base for j in jobs] == [None, "v0_2025-01-01T00.db", "v0_2025-01-01T00.db", "v1_2025-01-07T01.db", "v1_2025-01-07T01.db"]
    with pytest.raises(Exception, match="no base for major version 1"):
        planner.plan(archives(spark), done(spark, ["v1.024_2025-01-08T02.db"])).collect()
    assert planner.plan(archives(spark).limit(0), done(spark, DONE)).count() == 0
    ran = []
    assert planner.execute(planner.plan(archives(spark), done(spark, DONE[:3])), lambda j: ran.append(j["name"])) == 3 and ran == sorted(ran, key=lambda n: n[-16:])


def test_plan_latest(spark):
    assert planner.plan_latest(archives(spark)).first().name == "v1_2025-01-09T00.db"
    assert planner.plan_latest(archives(spark), diff_style_name=True).first().name == "v1.048_2025-01-09T00.db"


def test_listing(spark):
    rows = [("full/full_2026-06-03T22-11-00Z.db", 5, "file"), ("full", 0, "directory"), ("other/x.db", 1, "file")]
    entries = spark.createDataFrame(rows, "path string, size long, type string")
    assert [(r.dt, r.size) for r in planner.listing(entries, "full/").collect()] == [(datetime(2026, 6, 3, 22, 11), 5)]
    bad = entries.union(spark.createDataFrame([("full/odd.db", 1, "file")], entries.schema))
    with pytest.raises(Exception, match="no archive time"):
        planner.listing(bad, "full/").collect()


def test_version_order_and_url(spark):
    rows = spark.createDataFrame([("v10",), ("v2.100",), ("v2",), ("v2.024",), ("vx",)], "v string")
    assert [r.v for r in rows.orderBy(*tf.version_sort_key(F.col("v"))).collect()][1:] == ["v2", "v2.024", "v2.100", "v10"]
    url = rows.limit(1).select(tf.download_url(F.lit("https://h/a/tree/main/f"), F.lit("f/x.db")).alias("u")).first().u
    assert url == "https://h/a/resolve/f/x.db"


def test_read_listing(spark, tmp_path):
    rows = [{"path": "full/full_2026-06-03T22-11-00Z.db", "size": 5, "type": "file", "oid": "x"}, {"path": "full", "type": "directory"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text("[]")
    entries = planner.read_listing(spark, str(tmp_path))
    assert [(r.path, r.size, r.type) for r in entries.orderBy("path").collect()] == [("full", None, "directory"), (rows[0]["path"], 5, "file")]
    assert planner.listing(entries, "full/").count() == 1


def test_catalog(spark):
    names = [("v1_first.db", False), ("v2.db", False), ("v3_a_b.db", False), ("v4_x.db", True), ("w1_x.db", False), ("v1_second.db", False), ("v5.png", False)]
    rows = spark.createDataFrame([(n, d, i) for i, (n, d) in enumerate(names)], "name string, is_dir boolean, ord long")
    assert sorted(map(tuple, planner.catalog(rows).collect())) == [("v1", "second", "v1_second.db"), ("v2", "", "v2.db"), ("v3", "", "v3_a_b.db")]


def test_folder_entries(spark, tmp_path):
    """Names, folders and sizes in name order; subfolders as tasks of their own; contents aren't read."""
    from tessella.sources.listing import read_entries

    files = [n for n in DONE if n != "tmp"]
    for name in files:
        (tmp_path / name).write_bytes(b"x" * 3)
    (tmp_path / "tmp").mkdir()
    (tmp_path / "tmp" / "v9_2025-03-01T00.db").write_bytes(b"")
    rows = read_entries(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.name for r in rows] == sorted(DONE) and [r.name for r in rows if r.is_dir] == ["tmp"]
    assert {r.size for r in rows if not r.is_dir} == {3}
    assert planner.done_latest(planner.done(read_entries(spark, str(tmp_path)))).first().name == planner.done_latest(done(spark, DONE)).first().name
    assert read_entries(spark, str(tmp_path), below=True).where("not is_dir").count() == len(files) + 1
    with pytest.raises(Exception, match="FileNotFound|No such"):
        read_entries(spark, str(tmp_path / "none")).collect()
