"""A table cut into ranges of its id, of which each is one task's share."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ID = -(1 << 63)


def key(id_col: str) -> Column:
    """The id as long; a null id sorts before all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def ranges(docs: DataFrame, id_col: str) -> list[tuple[int, int, int]]:
    """(least id, largest id, rows) of ranges of about equal rows, ascending: about one for each input partition.

    Only the ids are shuffled, and only one row for each range comes to the driver. Equal ids are in one range.
    """
    spark = docs.sparkSession
    n = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    ids = docs.select(key(id_col).alias("k")).repartitionByRange(n, "k")
    rows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r.a, r.b, r.n) for r in rows)


def range_of(found: list[tuple[int, int, int]], k: Column) -> Column:
    """The number of the range that holds k."""
    lasts = np.array([b for _, b, _ in found], np.int64)

    @F.pandas_udf(T.IntegerType())
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(lasts, ids.to_numpy()), len(lasts) - 1).astype(np.int32))

    return number(k)


def range_and_next(found: list[tuple[int, int, int]], k: Column) -> Column:
    """The range that holds k and, for a range's largest id, also the following range (after the last: the first)."""
    lasts = [b for _, b, _ in found]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(ids: pd.Series) -> pd.Series:
        own = [min(bisect_left(lasts, i), len(lasts) - 1) for i in ids]
        return pd.Series([[r, (r + 1) % len(lasts)] if i == lasts[r] and len(lasts) > 1 else [r] for i, r in zip(ids, own)])

    return numbers(k)
