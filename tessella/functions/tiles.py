"""Column functions: tile addresses, versions, archive names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US, WEEK_HOURS = 3_600_000_000, 168
EPOCH = "2025-01-01"


def tile_key(z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", z, x, y)


def etag(version: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit('"'), version, F.lit("-"), tile_key(z, x, y), F.lit('"'))


def valid_tile(z: Column, x: Column, y: Column, deepest: int = 11) -> Column:
    side = F.call_function("shiftleft", F.lit(1), F.greatest(F.least(z, F.lit(30)), F.lit(0)))
    return z.between(0, deepest) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def whole_number(text: Column) -> Column:
    """The int that all of text spells, else null."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def leading_number(text: Column) -> Column:
    """The int that text begins with, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def hours_since(ts: Column, epoch: str = EPOCH) -> Column:
    """Whole hours from the epoch, towards zero; ts is a timestamp without or with the session's zone (UTC)."""
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(epoch).cast("timestamp"))
    return _div(micros, HOUR_US)


def _div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, F.lit(b))


def version_of(ts: Column, epoch: str = EPOCH) -> Column:
    """struct(major, minor, is_base): weeks since the epoch and the hour in the week."""
    hours = hours_since(ts, epoch)
    return F.struct(_div(hours, WEEK_HOURS).cast("int").alias("major"), (hours % WEEK_HOURS).cast("int").alias("minor"), F.lit(False).alias("is_base"))


def parse_version(text: Column) -> Column:
    """struct(major, minor, is_base) of v1 (a base) or v1.024; null if it is neither."""
    parts = F.split(F.regexp_replace(text, "^v", ""), r"\.", -1)
    major, minor = leading_number(F.get(parts, 0)), leading_number(F.get(parts, 1))
    base = F.size(parts) == 1
    good = major.isNotNull() & (base | ((F.size(parts) == 2) & minor.isNotNull()))
    return F.when(good, F.struct(major.alias("major"), F.coalesce(minor, F.lit(0)).alias("minor"), base.alias("is_base")))


def format_version(version: Column) -> Column:
    return F.when(version["is_base"], F.format_string("v%d", version["major"])).otherwise(F.format_string("v%d.%03d", version["major"], version["minor"]))


def output_name(version: Column, ts: Column) -> Column:
    return F.concat(format_version(version), F.lit("_"), F.date_format(ts, "yyyy-MM-dd'T'HH"), F.lit(".db"))


def archive_time(path: Column) -> Column:
    """Time of full/full_2026-06-03T22-11-00Z.db: behind the last slash and the first underscore; null if malformed."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.db$", "")
    stamp = F.when(F.instr(name, "_") > 0, F.regexp_replace(name, "^[^_]*_", "")).otherwise(name)
    fixed = F.regexp_replace(stamp, r"^([^T]*T[^-]*)-([^-]*)-", "$1:$2:")
    return F.when(fixed.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(fixed))


#: A done file's name: major, optional minor (a number may be followed by other characters) and hour.
DONE = r"^v\s*([+-]?\d+)[^._]*(?:\.\s*([+-]?\d+)[^._]*)?_(\d{4}-\d\d-\d\dT\d\d)\.db$"


def done_fields(name: Column) -> list[Column]:
    """major, minor, is_base and dt of v1.024_2025-01-08T02.db; all null for other names."""
    part = lambda i: F.nullif(F.regexp_extract(name, DONE, i), F.lit(""))
    dt = F.try_to_timestamp(part(3), F.lit("yyyy-MM-dd'T'HH"))
    minor = part(2).try_cast("int")
    return [part(1).try_cast("int").alias("major"), F.coalesce(minor, F.lit(0)).alias("minor"), minor.isNull().alias("is_base"), dt.alias("dt")]


def version_sort_key(version: Column) -> list[Column]:
    """Order by the number behind v, then by the text."""
    return [F.regexp_replace(version, "^v", "").try_cast("double"), version]


def download_url(tree_url: Column, path: Column) -> Column:
    return F.concat(F.substring_index(tree_url, "/tree/", 1), F.lit("/resolve/"), path)
