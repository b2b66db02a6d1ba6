"""Totals of questions from many blocks: plain counters, one owner for each key, bounded rows and groups."""

import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessella.llm import exchange

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
BLOCKS = 60


def keys_of(block):
    """Two keys of every block, some of neighbouring blocks, many of its own."""
    return np.unique(np.array([5, 7, *(100 + (block + i) // 3 for i in range(4)), *(10_000 + block * 50 + i for i in range(50))], np.uint64))


def questions(row):
    keys = keys_of(row["block"])
    return [(keys, np.stack([np.full(len(keys), row["block"] + 1), keys.astype(np.int64) % 4])), (keys[:2], np.array([1, row["block"]]))]


def reply(found):
    every = np.vstack([found.counts, found.askers()])
    return [exchange.small(np.vstack([every[:, p], own])) for p, own in zip(found.places, found.first_asks())]


def summary(found):
    return exchange.packed(np.array([found.question, len(found.keys), found.counts[0].sum(), found.askers().sum()], np.int64))


@pytest.fixture
def blocks(spark):
    return spark.range(BLOCKS).select((F.col("id") * (1 << 32)).alias("at"), F.col("id").alias("block")).repartition(6)


@pytest.mark.parametrize("slice_blocks", [1, 7, 4096])
def test_totals(spark, blocks, slice_blocks, monkeypatch):
    monkeypatch.setattr(exchange, "SLICE_BLOCKS", slice_blocks)
    shape = exchange.Shape.of(blocks)
    assert shape.slices == -(-BLOCKS // slice_blocks)
    answers = exchange.answered(exchange.ask(blocks, questions, shape.parts), shape, "test", summary, reply)
    want, asked, owners, second = Counter(), Counter(), Counter(), Counter()
    for b in range(BLOCKS):
        for k in keys_of(b).tolist():
            want[k] += b + 1
            asked[k] += 1
            second[k] += k % 4
    seen = 0
    for row in exchange.gathered(answers).collect():
        answer, keys = [a.asDict() for a in row.answers], keys_of(row.block)
        got = exchange.in_order(answer, keys, shape.parts, 0, lambda b: exchange.from_small(b).reshape(4, -1))
        assert got[0].tolist() == [want[k] for k in keys.tolist()] and got[1].tolist() == [second[k] for k in keys.tolist()]
        assert got[2].tolist() == [asked[k] for k in keys.tolist()]
        owners.update(keys[got[3] > 0].tolist())
        other = exchange.in_order(answer, keys[:2], shape.parts, 1, lambda b: exchange.from_small(b).reshape(3, -1))
        assert other[:2].tolist() == [[BLOCKS, sum(range(BLOCKS))], [BLOCKS, BLOCKS]]
        seen += 1
    assert seen == BLOCKS and owners == Counter(want.keys())
    sums = Counter()
    for row in answers.where("kind = 'summary'").collect():
        question, *numbers = exchange.unpacked(row.counts, np.int64).tolist()
        for i, n in enumerate(numbers):
            sums[question, i] += n
    assert [sums[0, i] for i in range(3)] == [len(want), sum(want.values()), sum(asked.values())]
    assert [sums[1, i] for i in range(3)] == [2, BLOCKS + sum(range(BLOCKS)), 2 * BLOCKS]


def test_rows_and_groups_are_bounded(spark, monkeypatch):
    """With slices the rows of a block and those that a cell hears stay the same as blocks grow."""
    monkeypatch.setattr(exchange, "SLICE_BLOCKS", 40)
    found = {}
    for n in (400, 1600):
        blocks = spark.range(n).withColumnRenamed("id", "block")
        shape = exchange.Shape.of(blocks)
        asked = exchange.ask(blocks, questions, shape.parts).where(F.col("part") < shape.parts)
        cells = asked.groupBy("part", F.pmod(F.xxhash64("block"), F.lit(shape.slices)).alias("slice")).count()
        found[n] = asked.count() / n, cells.agg(F.max("count")).first()[0]
        assert shape.finer == shape.parts * shape.slices
    assert found[1600][0] <= 1.1 * found[400][0] and found[400][1] < 90 and found[1600][1] < 90


def test_finer_parts_are_within_parts():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    shape = exchange.Shape(12, 5)
    part, finer = np.empty(5000, int), np.empty(5000, int)
    for out, n in ((part, shape.parts), (finer, shape.finer)):
        order, begins = exchange.by_part(keys, n)
        for p in range(n):
            out[order[begins[p] : begins[p + 1]]] = p
    assert (finer % shape.parts == part).all() and len(set(finer.tolist())) == 60
