"""A join whose frequent keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TURN = 100_000


def split_join(left: DataFrame, right: DataFrame, key: str, count: str, spread: str, how: str = "left", rows_per_turn: int = ROWS_PER_TURN) -> DataFrame:
    """left joined to right, of one row for each key; count (a column of right, not in the result) is how many rows of left have the key.

    A key of more than rows_per_turn rows gets several turns: right's row is repeated for each, left's rows are
    dealt to them by a hash of the column spread. Only the keys with several turns are broadcast: there are at
    most (rows of left) / rows_per_turn of them.
    """
    turns = F.greatest(F.ceil(F.col(count) / rows_per_turn), F.lit(1))
    frequent = right.where(F.col(count) > rows_per_turn).select(F.col(key).alias("__key"), turns.alias("__turns"))
    dealt = left.join(F.broadcast(frequent), F.col(key) == F.col("__key"), "left").drop("__key")
    dealt = dealt.withColumn("__turn", F.when(F.col("__turns").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), "__turns"))).drop("__turns")
    copies = right.withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1))).drop(count)
    return dealt.withColumn("__turn", F.col("__turn").cast("long")).join(copies, [key, "__turn"], how).drop("__turn")
