"""Benchmark decontamination by winnowing.

Each text's k-word hashes are thinned to the minimum of every w = window - k + 1 consecutive ones.
Two texts that share `window` consecutive words share such a minimum, so the join of the kept
fingerprints misses no shared span. A join hit is extended over the windows that contain it: each of
these windows of the text is looked up among the items' windows once, however many items and places
have the fingerprint, so that time is linear in texts of repeated words, too. Items of fewer words than a
window are one span: for these lengths every position of a document is a fingerprint (w = 1).
Words and windows are compared by 64-bit hashes.

Defined cases: a null text has no words; null ids of documents are ids like others; repeated rows get
equal rows; an item without words hits nothing; empty tables give empty results or documents without
hits. With null_items, items with a null id hit like others and are one null in the documents' items
(the last one), so that it counts as an item; without, they are left out. Only the named columns are
read, so that other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.skew import split_join
from tessella.llm.storage import bounded_batches, discard, trimmed, written
from tessella.llm.wordhash import U, grams, starts_of_grams, text_words

SPANS = "array<struct<start:int,end:int>>"
WINDOWS = "array<struct<at:int,h:long>>"
#: A character of some word.
HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: What an item's row takes besides its text and id, where items are sent to all workers.
ROW_BYTES = 128


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Which hashes are the minimum of some w consecutive ones (all of several equal minima)."""
    if len(hashes) < w:
        return np.ones(len(hashes), bool)
    least = hashes[: len(hashes) - w + 1]
    for i in range(1, w):
        least = np.minimum(least, hashes[i : len(hashes) - w + 1 + i])
    most = np.full(len(hashes), 0, np.uint64)  # the largest minimum of the windows around each hash
    for i in range(w):
        view = most[i : i + len(least)]
        np.maximum(view, least, out=view)
    return most == hashes


def fingerprints(words: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in the text) of the winnowed k-grams of the texts with a window at least.

    Windows that cross two texts are winnowed too: they only add fingerprints.
    """
    h = grams(words, k)
    keep, text = starts_of_grams(offsets, k)
    if not len(h):
        return h, text, text
    at = np.flatnonzero(keep & winnowed(h, window - k + 1))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    return h[at], text, at - offsets[text]


def every(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of all n-grams."""
    keep, text = starts_of_grams(offsets, n)
    at = np.flatnonzero(keep)
    return grams(words, n)[at], text, at - offsets[text]


def around(at: np.ndarray, text: np.ndarray, offsets: np.ndarray, n: int, window: int) -> np.ndarray:
    """Where, among all words, the windows of the texts begin that contain the n words from position at, each once."""
    begins = offsets[text][:, None] + at[:, None] - np.arange(window - n + 1)
    yes = (begins >= offsets[text][:, None]) & (begins + window <= offsets[text + 1][:, None])
    return np.unique(begins[yes])


class Items:
    """The benchmark's fingerprints and windows, by window length: sorted hashes, and the items of each window."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int, k: int):
        self.window, self.k = window, k
        self.names = [name for name, _ in rows]
        words, offsets = text_words([text.lower() for _, text in rows])
        sizes = np.diff(offsets)
        #: window length, gram length: fingerprints, windows, where each one's items begin, items.
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for length, n in [(window, k), *((int(s), int(s)) for s in np.unique(sizes[(sizes > 0) & (sizes < window)]))]:
            prints, item, _ = fingerprints(words, offsets, window, n) if length == window else every(words, offsets, n)
            windows, own, _ = every(words, offsets, length)
            mine = (lambda i: sizes[i] >= window) if length == window else (lambda i: sizes[i] == length)  # noqa: B023
            pairs = np.unique(np.stack([windows[mine(own)], own[mine(own)].astype(U)]), axis=1)
            keys, begins = np.unique(pairs[0], return_index=True)
            if len(keys):
                self.tables.append((length, n, np.unique(prints[mine(item)]), keys, np.append(begins, pairs.shape[1]), pairs[1].astype(np.int64)))

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[list[str | None]]]:
        """Per text: word spans inside windows of items, joined, and the items' names."""
        n = len(offsets) - 1
        gapped = offsets + np.arange(n + 1)  # where texts begin with a place left free between two
        change, found = np.zeros(gapped[-1] + 1, np.int64), []
        for length, gram, prints, keys, first, items in self.tables:
            h, text, at = fingerprints(words, offsets, self.window, gram) if length == self.window else every(words, offsets, gram)
            hit = members(h, prints)
            begins = around(at[hit], text[hit], offsets, gram, length)
            if not len(begins):
                continue
            with_grams = grams(words, length)[begins]
            yes = members(with_grams, keys)
            begins, window = begins[yes], np.searchsorted(keys, with_grams[yes])
            text = np.searchsorted(offsets, begins, "right") - 1
            np.add.at(change, begins + text, 1)
            np.add.at(change, begins + text + length, -1)
            # Each window of a text once, and then each of its items.
            each = np.unique(np.stack([text, window]), axis=1)
            many = first[each[1] + 1] - first[each[1]]
            place = np.repeat(first[each[1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append(np.unique(np.stack([np.repeat(each[0], many), items[place]]), axis=1))
        inside = (np.cumsum(change) > 0).astype(np.int8)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        names: list[list[str | None]] = [[] for _ in range(n)]
        edge = np.diff(inside, prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = np.searchsorted(gapped, starts, "right") - 1
        for t, a, b in zip(own.tolist(), (starts - gapped[own]).tolist(), (ends - gapped[own]).tolist()):
            spans[t].append((a, b))
        for t, i in (np.unique(np.concatenate(found, axis=1), axis=1).T.tolist() if found else []):
            names[t].append(self.names[i])
        return spans, [sorted(set(x), key=lambda x: (x is None, x or "")) for x in names]


def members(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values if len(keys) else np.zeros(len(values), bool)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def as_spans(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, broadcast_bytes: int = 16 << 20, null_items: bool = False) -> DataFrame:
    """Per document (id_col): n_words long, spans (hit words, joined, end exclusive), items (their ids as strings).

    The items with words go to every worker, which keeps their index, while they have at most broadcast_bytes of
    text, ids and ROW_BYTES a row (the index takes about 40 bytes a word, some 7 times the text); beyond that, both
    sides' fingerprints and then their windows are joined by a shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    if not null_items:
        items = items.where("item is not null")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.where(F.col("text").rlike(HAS_WORD))
    # An item's id and its row on the driver and in the index count, too.
    each = F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + ROW_BYTES
    if (items.agg(F.sum(each)).first()[0] or 0) <= broadcast_bytes:
        out = _by_broadcast(docs, items, window, k)
    else:
        out = _by_shuffle(docs, items, window, k)
    return out.withColumnRenamed("id", id_col)


_indexes: dict[str, Items] = {}


def _index(name: str, rows: list[tuple[str | None, bytes]], window: int, k: int) -> Items:
    """The worker's index of the job's items: made by its first task and kept for the others, one job's at a time."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Items(rows, window, k)
    return _indexes[name]


def _by_broadcast(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows, name = spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in items.collect()]), uuid.uuid4().hex
    kind = docs.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = text_words(as_bytes(batch.column(1)))
            spans, names = _index(name, rows.value, window, k).hits(words, offsets)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array([as_spans(s) for s in spans], SPAN_TYPE), pa.array(names, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return docs.mapInArrow(trimmed(scan), f"id {kind}, n_words long, spans {SPANS}, items array<string>")


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """Rows are told apart by (id, text): equal rows have equal results.

    First the documents' fingerprints are joined to the items', then the windows that contain a hit to the
    items' windows; only hashes and places are shuffled. Hashes that many documents have are dealt over tasks.
    """
    key = F.sha2(F.to_json(F.struct(F.col("id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))), 256)  # a null id has no field
    docs = docs.withColumn("key", key)
    once = docs.dropDuplicates(["key"]).select("key", "text")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(text_words(as_bytes(batch.column(0)))[1])
            yield pa.record_batch([pa.array(n, pa.int64())], ["n"])

    short = sorted(r.n for r in items.select("text").mapInArrow(sized, "n long").where(f"n > 0 and n < {window}").distinct().collect())
    lengths = [(window, k), *((n, n) for n in short)]

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(length, hash, item) of fingerprints (item: null, whole false) and windows."""
        for batch in batches:
            words, offsets = text_words(as_bytes(batch.column(1)))
            sizes, names = np.diff(offsets), np.array(batch.column(0).to_pylist(), object)
            for length, n in lengths:
                for whole in (False, True):
                    h, text, _ = every(words, offsets, length) if whole or length != window else fingerprints(words, offsets, window, n)
                    yes = sizes[text] >= window if length == window else sizes[text] == length
                    h, text = h[yes], text[yes]
                    yield pa.record_batch([pa.array(np.full(len(h), length), pa.int32()), pa.array(h.view(np.int64)), pa.array(np.full(len(h), whole)), pa.array(names[text] if whole else [None] * len(h), pa.string())], ["length", "h", "whole", "item"])

    known = written(items.select("item", "text").mapInArrow(of_items, "length int, h long, whole boolean, item string").distinct(), "benchmark-windows")

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints with the hashes and places of the windows around them."""
        for batch in batches:
            words, offsets = text_words(as_bytes(batch.column(1)))
            keys = np.array(batch.column(0).to_pylist(), object)
            for length, n in lengths:
                h, text, at = fingerprints(words, offsets, window, n) if length == window else every(words, offsets, n)
                whole, reach = grams(words, length).view(np.int64), np.arange(length - n + 1)
                begins = offsets[text][:, None] + at[:, None] - reach
                yes = (begins >= offsets[text][:, None]) & (begins + length <= offsets[text + 1][:, None])
                flat = begins[yes]
                inner = pa.StructArray.from_arrays([pa.array(flat - np.repeat(offsets[text], yes.sum(1)), pa.int32()), pa.array(whole[flat], pa.int64())], names=["at", "h"])
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(yes.sum(1))]), pa.int32()), inner)
                yield pa.record_batch([pa.array(keys[text], pa.string()), pa.array(np.full(len(h), length), pa.int32()), pa.array(h.view(np.int64)), windows], ["key", "length", "h", "windows"])

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """left's rows whose (length, h) right has, with right's items."""
        both = lambda df: df.withColumn("lh", F.struct("length", "h")).drop("length", "h")
        n = left.groupBy("length", "h").agg(F.count(F.lit(1)).alias("n"))
        return split_join(both(left), both(right.join(n, ["length", "h"])), "lh", "n", "key", "inner").select("*", "lh.length", "lh.h").drop("lh")

    prints = written(once.mapInArrow(trimmed(of_docs), f"key string, length int, h long, windows {WINDOWS}"), "fingerprints")
    hit = met(prints, known.where("not whole").select("length", "h"))
    windows = hit.select("key", "length", F.explode("windows").alias("w")).select("key", "length", "w.at", "w.h").distinct()
    windows = met(written(windows, "windows"), known.where("whole").groupBy("length", "h").agg(F.collect_set(F.struct("item")).alias("names")))
    windows = written(windows, "leak-windows")
    discard(prints)
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end"))
    union = F.expr("""aggregate(array_sort(all), cast(array() as array<struct<start:int,end:int>>), (acc, s) -> case
        when size(acc) > 0 and s.start <= element_at(acc, -1).end
        then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(s.end, element_at(acc, -1).end) as end)))
        else concat(acc, array(s)) end)""")
    spans = windows.groupBy("key").agg(F.collect_set(span).alias("all")).select("key", union.alias("spans"))
    names = windows.select("key", F.explode("names").alias("name")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("name"))["item"].alias("items"))
    names = names.select("key", F.concat(F.filter("items", lambda x: x.isNotNull()), F.filter("items", lambda x: x.isNull())).alias("items"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(text_words(as_bytes(batch.column(2)))[1])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "key", "n_words"])

    kind = docs.schema["id"].dataType.simpleString()
    counts = docs.select("id", "key", "text").mapInArrow(counted, f"id {kind}, key string, n_words long")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return counts.join(spans, "key", "left").join(names, "key", "left").select("id", "n_words", none("spans", SPANS), none("items", "array<string>"))
