"""Rows of one cell meet each other in bounded groups, without a list of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.skew import split_join

BLOCK = 512


def sizes(rows: DataFrame, home: Column | None = None) -> DataFrame:
    """Per cell: homes and all rows. home: which rows live in the cell (all, if not given); the others visit it."""
    lives = F.lit(True) if home is None else home
    return rows.groupBy("cell").agg(F.count(F.when(lives, 1)).alias("homes"), F.count(F.lit(1)).alias("n"))


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with cell, homes and n (see sizes), home and spread, as members of groups (cell, a, b), by group in each partition.

    Homes are dealt over blocks of about `block` rows by the long spread, and so are visitors. Two homes meet in
    one group exactly, and so do a home and a visitor; two visitors don't. A group has one block on its left
    (homes) and one on its right: of a group with a = b the left rows meet each other, too. A cell of n rows
    sends each row to n / block groups at most.
    """
    count = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("long")
    hb, vb = count(F.col("homes")), count(F.col("n") - F.col("homes"))
    mine = lambda n: F.pmod(F.xxhash64("spread", "cell"), n)
    to = lambda a, b, left: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(left).alias("left"))
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    as_home = F.concat(F.transform(F.sequence(mine(hb), hb + vb - 2), lambda b: to(mine(hb), b, True)), F.transform(until(mine(hb)), lambda a: to(a, mine(hb), False)))
    as_visitor = F.transform(until(hb), lambda a: to(a, F.when(mine(vb) == 0, a).otherwise(hb - 1 + mine(vb)), False))
    out = rows.withColumn("to", F.explode(F.when(F.col("home"), as_home).otherwise(as_visitor)))
    out = out.select(*(c for c in rows.columns if c not in ("homes", "n", "home", "spread")), "to.a", "to.b", "to.left")
    return out.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")


def with_sizes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with homes and n of their cells; rows of cells that found lacks go."""
    return split_join(rows, found.withColumn("__n", F.col("n")), "cell", "__n", "spread", "inner")


def by_group(work: Callable[[pa.RecordBatch, bool], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over dealt(): work(a group's rows, whether its left rows meet each other, too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that the last batch may have cut
        key = None

        def whole() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            if rows and rows[0].num_rows > 1 and (out := work(rows[0], key[1] == key[2])) is not None:
                yield out

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "a", "b")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if at == to:
                    continue
                if tuple(keys[at]) != key:
                    if held:
                        yield from whole()
                    held, key = [], tuple(keys[at].tolist())
                held.append(batch.slice(at, to - at))
        if held:
            yield from whole()

    return run
