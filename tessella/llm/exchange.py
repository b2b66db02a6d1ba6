"""Corpus-wide counts for blocks of documents, exchanged with hash partitions of the counted keys.

A block is some hundred thousand tokens of consecutive documents in one row. It sends each partition
the keys that hash there, once each, with its own counts; the partition adds up all blocks' counts and
sends every block the totals of what it asked for, in the order of the question. So the tables of
counts grow with the corpus and stay partitioned, a very common key is one entry of each block's list,
and a partition gets about PART_TOKENS tokens' worth of keys however many blocks there are.

Blocks are dealt into slices of about SLICE_BLOCKS by a hash. A partition belongs to a slice and hears from its blocks
alone; where there are several slices, its sums are asked for in the same way by finer partitions of the keys,
which hear from slices. So a block sends rows to a bounded number of partitions, and a partition with a word
of every block gets a row from each block of its slice, or from each slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import discard, trimmed, written
from tessella.llm.wordhash import U, mix, text_words

BLOCK_TOKENS = 1 << 18
#: Rows of a batch that holds blocks, of about a MB each.
BLOCK_ROWS = 2
#: Tokens of the blocks that ask a part: with few keys for each block and part their rows' overhead would count.
PART_TOKENS = 1 << 21
#: Blocks of a slice on average: a part hears from so many.
SLICE_BLOCKS = 1 << 12
#: Cells (parts of a slice) of a task.
TASK_CELLS = 16


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as all their first bytes, all second ones and so on: the high ones, mostly 0, pack to little."""
    return packed(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def gaps(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, by their differences."""
    return planes(np.diff(values, prepend=U(0)))


def from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Numbers from 0 (of several rows, one after the other)."""
    return planes(np.ascontiguousarray(values))


def from_small(data: bytes) -> np.ndarray:
    return from_planes(data).astype(np.int64)


def packed_ids(ids: pa.Array) -> bytes:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return packed(np.stack([ids.fill_null(0).to_numpy(), known.astype(np.int64)]))


def unpacked_ids(data: bytes) -> pa.Array:
    ids, known = unpacked(data, np.int64).reshape(2, -1)
    return pa.array(ids, mask=known == 0)


def token_blocks(batches: Iterator[pa.RecordBatch], kind: str, texts_of: Callable[[pa.RecordBatch], list[bytes]]) -> Iterator[tuple[int, list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Blocks of about BLOCK_TOKENS tokens: number (of no other block of the job), slices of batches, word hashes, words of each row."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def whole() -> tuple[int, list[pa.RecordBatch], np.ndarray, np.ndarray]:
        return number, [h[0] for h in held], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in batches:
        texts, at = texts_of(batch), 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= BLOCK_TOKENS):
                n += len(texts[to])
                to += 1
            words, offsets = text_words(texts[at:to], kind)
            held.append((batch.slice(at, to - at), words, np.diff(offsets)))
            size += len(words)
            at = to
            if size >= BLOCK_TOKENS:
                yield whole()
                held, size, number = [], 0, number + 1
    if held:
        yield whole()


@dataclass(frozen=True)
class Shape:
    """Hash parts that a block sends to, and slices that the blocks are dealt into."""

    parts: int
    slices: int = 1

    @classmethod
    def of(cls, blocks: DataFrame) -> Shape:
        """For a written table of blocks."""
        n, tasks = blocks.count(), int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = max(1, -(-n // SLICE_BLOCKS))
        return cls(max(-(-tasks // slices), -(-n * BLOCK_TOKENS // (slices * PART_TOKENS))), slices)

    @property
    def finer(self) -> int:
        """Parts of the slices' sums; those of part p are p, p + parts, p + 2 * parts and so on."""
        return self.parts * self.slices


def by_part(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys by part, in order within a part; where each part begins there)."""
    part = (mix(keys) % U(n)).astype(np.uint16 if n < 1 << 16 else np.uint32)  # 16 bits are sorted in linear time
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n))])


Question = tuple[np.ndarray, np.ndarray]


def dealt(number: int, question: int, keys: np.ndarray, counts: np.ndarray, n: int) -> tuple[list[int], list[int], list[bytes], list[bytes]]:
    """Columns part, block (number), keys and counts of the i-th question to n parts."""
    order, begins = by_part(keys, n)
    own = np.flatnonzero(np.diff(begins))
    mine = [order[begins[p] : begins[p + 1]] for p in own]
    return (own + question * n).tolist(), [number] * len(own), [gaps(keys[x]) for x in mine], [small(counts[..., x]) for x in mine]


ASKED = "part int, block long, keys binary, counts binary"


def ask(blocks: DataFrame, questions: Callable[[dict], list[Question]], n: int) -> DataFrame:
    """Rows (part, block, keys, counts): each block's ascending keys with counts, by hash part.

    questions(block row) gives a list of (ascending keys, counts); counts may have several rows. The parts of
    the i-th question are i * n to (i + 1) * n - 1.
    """
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for i, (keys, counts) in enumerate(questions(row)):
                    columns = [pa.array(c, t) for c, t in zip(dealt(row["block"], i, keys, counts, n), types)]
                    yield pa.record_batch(columns, ["part", "block", "keys", "counts"])

    return blocks.mapInArrow(trimmed(run), ASKED)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values ascending, a place of each, which of them each value is)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int32)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


@dataclass(frozen=True)
class Totals:
    """A part's question from its blocks: rows of the distinct keys' totals, each block's places among the keys."""

    question: int
    part: int
    keys: np.ndarray
    counts: np.ndarray
    blocks: list[int]
    places: list[np.ndarray]
    last: list[np.ndarray]  # of each block's counts the last row, whether it is above 0
    # Of a slice among others: how many blocks of all asked for a key, whether no slice before it did.
    asked: np.ndarray | None = None
    leads: np.ndarray | None = None

    @classmethod
    def of(cls, group: pd.DataFrame, n: int) -> Totals:
        """group: a part's rows of ask() to n parts."""
        group = group.sort_values("block")
        keys = [from_gaps(k) for k in group["keys"]]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        every, place = distinct(np.concatenate(keys))[::2]
        del keys
        places, counts, last = np.split(place.astype(np.int32), ends), None, []
        for c, at in zip(group["counts"], places):  # one block's counts at a time
            own = from_small(c).reshape(-1, len(at)) if len(at) else np.zeros((0, 0), np.int64)
            counts = np.zeros((len(own), len(every)), np.int64) if counts is None else counts
            counts[:, at] += own
            last.append(own[-1] > 0)
        part = int(group["part"].iloc[0])
        return cls(part // n, part, every, counts, group["block"].tolist(), places, last)

    def askers(self) -> np.ndarray:
        """How many blocks asked for each key."""
        return self.asked if self.asked is not None else np.bincount(np.concatenate(self.places), minlength=len(self.keys))

    def first_asks(self) -> list[np.ndarray]:
        """Which of each block's keys no block before it asked for: every key has one such block."""
        place = np.concatenate(self.places)
        first = np.empty(len(self.keys), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        found = first[place] == np.arange(len(place))
        if self.leads is not None:
            found &= self.leads[place]
        return np.split(found, np.cumsum([len(p) for p in self.places])[:-1])


ANSWER = "kind string, part int, block long, counts binary"


def own_totals(found: Totals) -> list[bytes]:
    return [small(found.counts[0][p]) for p in found.places]


Summary = Callable[[Totals], bytes]
Reply = Callable[[Totals], list[bytes]]


def answered(asked: DataFrame, shape: Shape, label: str, summary: Summary | None = None, reply: Reply = own_totals) -> DataFrame:
    """A written table. Kind answer: reply's for each block, in the order it asked. Kind summary, if asked for: of a part's totals of all blocks."""
    if shape.slices > 1:
        return _answered_by_slices(asked, shape, label, summary, reply)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = Totals.of(group, shape.parts)
        return _rows(found, reply(found), summary)

    return written(asked.repartition(shape.parts, "part").groupBy("part").applyInPandas(run, ANSWER), label)


def _rows(found: Totals, answers: list[bytes], summary: Summary | None = None) -> pd.DataFrame:
    rows = [("answer", found.part, b, a) for b, a in zip(found.blocks, answers)]
    rows += [("summary", found.part, None, summary(found))] if summary else []
    return pd.DataFrame(rows, columns=["kind", "part", "block", "counts"]).astype({"block": "Int64"})


def _answered_by_slices(asked: DataFrame, shape: Shape, label: str, summary: Summary | None, reply: Reply) -> DataFrame:
    parts, finer = shape.parts, shape.finer
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-finer // TASK_CELLS))
    # The questions are made anew for each of the two jobs: a table of them beside a job's shuffles would be the most of all on disk.
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(shape.slices)))
    cells = asked.repartition(tasks, "part", "slice").groupBy("part", "slice")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        """The slice asks as a block does, with a last row of how many blocks asked."""
        found = Totals.of(group, parts)
        columns = dealt(int(group["slice"].iloc[0]), found.question, found.keys, np.vstack([found.counts, found.askers()]), finer)
        return pd.DataFrame(dict(zip(("part", "block", "keys", "counts"), columns)))

    def total(group: pd.DataFrame) -> pd.DataFrame:
        """To each slice the totals, and whether it is the first one that asked."""
        found = Totals.of(group, finer)
        answers = [small(np.vstack([found.counts[:, p], first])) for p, first in zip(found.places, found.first_asks())]
        return _rows(replace(found, counts=found.counts[:-1], asked=found.counts[-1]), answers, summary)

    def answer(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        found = Totals.of(group, parts)
        size = len(found.counts) + 2
        every = in_order(told[["finer", "counts"]].rename(columns={"finer": "part"}).to_dict("records"), found.keys, finer, found.question, lambda b: from_small(b).reshape(size, -1))
        found = replace(found, counts=every[:-2], asked=every[-2], leads=every[-1] > 0)
        return _rows(found, reply(found))

    totals = cells.applyInPandas(add, ASKED).repartition(tasks, "part").groupBy("part").applyInPandas(total, ANSWER)
    totals = written(totals, f"{label}-totals")
    question, place = F.floor(F.col("part") / finer), F.col("part") % finer % parts
    told = totals.where("kind = 'answer'").select((question * parts + place).cast("int").alias("part"), F.col("block").alias("slice"), F.col("part").alias("finer"), "counts")
    told = told.repartition(tasks, "part", "slice").groupBy("part", "slice")
    out = written(cells.cogroup(told).applyInPandas(answer, ANSWER).unionByName(totals.where("kind = 'summary'")), label)
    discard(totals)
    return out


def summed(answers: DataFrame, n: int) -> np.ndarray:
    """The sum of all parts' summaries, of n numbers each, added up by the tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += unpacked(data, np.int64)
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])

    sums = answers.where("kind = 'summary'").select("counts").mapInArrow(add, "sums array<long>")
    row = sums.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n))).first()
    return np.array([x or 0 for x in row], np.int64)


def gathered(answers: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per block its answers by part; partitions: of how many a table of blocks is bucketed."""
    answers = answers.where("kind = 'answer'")
    answers = answers.repartition(partitions, "block") if partitions else answers
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("answers"))


def in_order(answers: list[dict] | None, keys: np.ndarray, n: int, question: int = 0, decoded=from_small) -> np.ndarray:
    """The answers of all parts to the ascending keys of a question (or rows of answers)."""
    found = [(a["part"] - question * n, decoded(a["counts"])) for a in answers or [] if a["part"] // n == question]
    out = np.zeros((*(found[0][1].shape[:-1] if found else ()), len(keys)), found[0][1].dtype if found else np.int64)
    if found:
        order, begins = by_part(keys, n)
        for p, values in found:
            out[..., order[begins[p] : begins[p + 1]]] = values
    return out
