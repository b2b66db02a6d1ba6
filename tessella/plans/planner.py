"""Snapshot planning: which archives become weekly bases or diffs on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.tiles import archive_time, done_fields, output_name, version_of
from tessella.sources.scratch import written


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Entries (path, size, type) of remote listings stored as JSON: an array of objects for each file."""
    return spark.read.schema("path string, size long, type string").json(path, multiLine=True)


def listing(entries: DataFrame, folder: str) -> DataFrame:
    """Archives (path, size, dt, major, minor) of a remote listing (path, size, type); a file with a malformed name fails."""
    files = entries.where((F.col("type") == "file") & F.startswith(F.col("path"), F.lit(folder)))
    dt = archive_time(F.col("path"))
    checked = F.when(dt.isNull(), F.raise_error(F.concat(F.lit("no archive time in "), F.col("path")))).otherwise(dt)
    files = files.withColumn("dt", checked)
    return files.select("path", "size", "dt", version_of(F.col("dt")).alias("v")).select("path", "size", "dt", "v.major", "v.minor")


def done(names: DataFrame) -> DataFrame:
    """Finished archives (name, ord, major, minor, is_base, dt) of a folder's entries (name, is_dir, ord); others are left out."""
    rows = names.where("not is_dir").select("name", "ord", *done_fields(F.col("name")))
    return rows.where("major is not null and dt is not null")


def catalog(names: DataFrame) -> DataFrame:
    """Versions to serve (version, description, name) of a folder's entries (name, is_dir, ord): files v*.db.

    Of a stem version_description the two parts; with no or several underscores the description is empty. Of
    several files of one version the last listed one.
    """
    stem = F.split(F.regexp_replace("name", r"\.db$", ""), "_")
    files = names.where("not is_dir and name like 'v%.db'")
    rows = files.select(stem[0].alias("version"), F.struct("ord", F.when(F.size(stem) == 2, F.get(stem, F.lit(1))).otherwise("").alias("description"), "name").alias("file"))
    return rows.groupBy("version").agg(F.max("file").alias("file")).select("version", "file.description", "file.name")


def done_latest(rows: DataFrame) -> DataFrame:
    """The finished archive with the largest time; of several the first."""
    return rows.orderBy(F.desc("dt"), "ord").limit(1)


def done_days(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_date("dt").alias("day")).distinct()


def done_by_major(rows: DataFrame) -> DataFrame:
    """Per major its base (the last listed) and its diffs in listing order: a list for a major of few archives.

    done_bases and done_diffs give the same as rows.
    """
    base = F.max(F.when(F.col("is_base"), F.struct("ord", "name")))["name"]
    diffs = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_base"), F.struct("ord", "name")))), lambda d: d["name"])
    return rows.groupBy("major").agg(base.alias("base"), diffs.alias("diffs"))


def done_bases(rows: DataFrame) -> DataFrame:
    """Per major with a base the last listed one."""
    return rows.where("is_base").groupBy("major").agg(F.max(F.struct("ord", "name"))["name"].alias("base"))


def done_diffs(rows: DataFrame) -> DataFrame:
    """Diffs (major, position, name), from 1 in listing order: ranked in ranges of (major, ord), so that a major may have any number."""
    spark = rows.sparkSession
    n = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    diffs = rows.where(~F.col("is_base")).select("major", "ord", "name").repartitionByRange(n, "major", "ord", "name")
    diffs = written(diffs.withColumn("part", F.spark_partition_id()), "done-diffs")
    sizes = diffs.groupBy("major", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("major").orderBy("part")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("major", "part").orderBy("ord", "name"))
    return diffs.withColumn("own", own).join(sizes.select("major", "part", before.alias("before")), ["major", "part"]).select("major", (F.col("before") + F.col("own")).alias("position"), "name")


def plan(archives: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs (dt, major, minor, is_diff, base, name), for archives (dt, major, minor) against done().

    The first archive of each day that isn't done is taken. With a finished base of its major it is a
    diff on that; otherwise the first one of its major becomes the base and the others diffs on it.
    A finished major without a base fails the plan.
    """
    days = archives.groupBy(F.to_date("dt").alias("day")).agg(F.min(F.struct("dt", "major", "minor")).alias("a"))
    open_days = days.join(done_days(finished), "day", "left_anti").select("a.*")
    bases = finished.groupBy("major").agg(F.max(F.when(F.col("is_base"), F.struct("ord", "name")))["name"].alias("done_base"), F.lit(True).alias("known"))
    rows = open_days.join(bases, "major", "left")
    incomplete = F.coalesce(F.col("known"), F.lit(False)) & F.col("done_base").isNull()
    rows = rows.withColumn("done_base", F.when(incomplete, F.raise_error(F.concat(F.lit("no base for major version "), F.col("major").cast("string")))).otherwise(F.col("done_base")))
    # One row for each day: a major's few days meet in one task.
    first = rows.where("done_base is null").groupBy("major").agg(F.min(F.struct("dt", "minor")).alias("f"))
    rows = rows.join(first, "major", "left")
    is_diff = F.col("done_base").isNotNull() | (F.col("dt") > F.col("f.dt"))
    own = F.struct(F.col("major"), F.col("minor"), (~F.col("is_diff")).alias("is_base"))
    promoted = output_name(F.struct(F.col("major"), F.col("f.minor").alias("minor"), F.lit(True).alias("is_base")), F.col("f.dt"))
    rows = rows.withColumn("is_diff", is_diff)
    base = F.when(F.col("is_diff"), F.coalesce("done_base", promoted))
    return rows.select("dt", "major", "minor", "is_diff", base.alias("base"), output_name(own, F.col("dt")).alias("name"))


def described(jobs: DataFrame) -> DataFrame:
    """Jobs with a line for people: the name, and whether it is a whole archive or a diff on which base."""
    return jobs.withColumn("line", F.concat_ws(" ", "name", F.when(F.col("is_diff"), F.concat(F.lit("DIFF from "), "base")).otherwise("FULL")))


def plan_latest(archives: DataFrame, diff_style_name: bool = False) -> DataFrame:
    """A full job for the latest archive, whatever is done. diff_style_name keeps the name with the minor version."""
    last = archives.orderBy(F.desc("dt"), "major", "minor").limit(1)
    own = F.struct("major", "minor", F.lit(not diff_style_name).alias("is_base"))
    return last.select("dt", "major", "minor", F.lit(False).alias("is_diff"), F.lit(None).cast("string").alias("base"), output_name(own, F.col("dt")).alias("name"))


def execute(jobs: DataFrame, run: Callable[[dict], None]) -> int:
    """Runs jobs one by one in time order (a diff needs its base); the first error stops. A plan has a row per day."""
    n = 0
    for job in jobs.orderBy("dt").toLocalIterator():
        run(job.asDict())
        n += 1
    return n
