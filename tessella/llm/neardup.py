"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (all words of a shorter text). Its weight is its count in the
text times 1 + ln((1 + N) / (1 + df)), df the number of the N rows that have it. All shingles are
counted: blocks of documents send theirs to hash partitions and get the totals back (see exchange).
A text's own copies would make what they share light and each one's edits heavy, the more so the more
copies there are. So of a text's copies `copies` count at most, and no edit counts as rarer: where the
median df m of a text's shingles is above `copies`, each counts as df - (m - copies), `copies` at least.
Each text gets bands * rows samples (element, t), each a minimum over its weighted shingles; a band
hashes `rows` of them. Two texts of one band are candidates. They are first held against all samples,
then verified: weighted Jaccard similarity of `threshold` or more of the whole texts links them. Classes
are connected components. For the samples alone weights are rounded to powers of GRID (by 3 percent at
most), so that the variates are looked up; verification takes the weights themselves.

No bucket's pairs are listed. Equal texts are one node. In each bucket every text meets the bucket's
most central text (the one with most bucket mates over all bands); after the classes of these links
are known, texts outside a bucket's largest class visit the bucket's texts. Both are dealt in blocks of
`block` texts, of which a group holds one of either kind; samples are compared in memory and only pairs
near the threshold are emitted. Verification streams the texts' weighted shingles, at most `members`
texts behind one copy of their common partner's.

Defined cases: a null text counts as empty; texts without words are only copies of equal texts; rows
with equal ids and texts are one document; rows with equal ids and different texts are documents of
their own (classes may then have equal class_id: `first_digest` tells them apart); a class without any
id has a negative number from its texts; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import BLOCK_ROWS, Question, Shape, answered, ask, distinct, from_gaps, from_small, gaps, gathered, in_order, packed_ids, small, token_blocks, unpacked_ids
from tessella.llm.graph import components
from tessella.llm.skew import split_join
from tessella.llm.storage import bounded_batches, discard, small_batches, trimmed, written
from tessella.llm.wordhash import U, grams, mix, text_words

TABLE_BITS = 13  # so that the tables of the usual weights stay in the processor's cache
GRID, LEVELS = 1.06, 80
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    words: int = 5
    bands: int = 28
    rows: int = 8
    block: int = 256
    fine: int = 1024
    members: int = 256
    copies: int = 32

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def least(self, n: int) -> float:
        """The share of n samples that a candidate must have equal: the threshold less 3 standard errors."""
        return self.threshold - 3 * math.sqrt(self.threshold * (1 - self.threshold) / n)


def idf(df: np.ndarray | float, total: int) -> np.ndarray:
    return 1 + np.log((1 + total) / (1 + np.asarray(df)))


def without_copies(df: np.ndarray, copies: int) -> np.ndarray:
    """The row counts of a text's shingles with so many of its own copies at most; the median tells how many it has."""
    middle = len(df) // 2
    more = np.partition(df, middle)[middle] - copies
    return np.maximum(df - more, copies) if more > 0 else df


def as_bytes(column: pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def shingles(texts: list[bytes], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per (lower-cased) text its distinct shingles, sorted, and their counts."""
    words, offsets = text_words(texts)
    whole = grams(words, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1], return_counts=True))
        elif b > a:
            out.append((grams(words[a:b], b - a), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, U), np.zeros(0, np.int64)))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (ascending shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0


@cache
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    n = 1 << TABLE_BITS
    return rng.gamma(2.0, 1.0, n), np.log(rng.gamma(2.0, 1.0, n)), rng.random(n)


def _sample_keys(index: np.ndarray, log_weight: np.ndarray | float) -> np.ndarray:
    """ln a as an ordered 32-bit number, above a hash of t."""
    r, log_c, beta = (v[index] for v in _variates())
    t = np.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta) - r
    order = np.clip((log_a + 64) * (1 << 24), 0, (1 << 32) - 1).astype(U)
    return order << U(32) | mix(t.astype(np.int64).view(U) + U(0x5851F42D4C957F2D)) & U(0xFFFFFFFF)


@cache
def _multipliers(n: int) -> np.ndarray:
    """The first n of one sequence, so that fewer samples are the first of more."""
    return np.random.default_rng(7).integers(0, 1 << 63, 4096, dtype=np.uint64)[:n] * U(2) + U(1)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Sample keys by level of the weight and table index, and which levels are filled in."""
    return np.empty(LEVELS << TABLE_BITS, U), np.zeros(LEVELS, bool)


def _level_keys(levels: np.ndarray) -> np.ndarray:
    keys, filled = _tables()
    for level in np.unique(levels[levels < LEVELS]).tolist():
        if not filled[level]:
            keys[level << TABLE_BITS : (level + 1) << TABLE_BITS] = _sample_keys(np.arange(1 << TABLE_BITS), level * math.log(GRID))
            filled[level] = True
    return keys


def samples(hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """n samples (32-bit hashes of element and t) of each text, whose shingles begin at begins; every text has one at least."""
    levels = np.rint(np.log(weights) / math.log(GRID)).astype(np.int64)
    tables, low = _level_keys(levels), hashes & U(0xFFFFFFFF)
    rare = np.flatnonzero(levels >= LEVELS)  # weights over 100
    base, shift = (np.where(levels < LEVELS, levels, 0) << TABLE_BITS).astype(U), U(64 - TABLE_BITS)
    out, at, keys = np.empty((len(begins), n), np.uint32), np.empty_like(base), np.empty_like(base)
    place = at.view(np.int64)
    for k, m in enumerate(_multipliers(n)):
        np.multiply(hashes, m, out=at)
        np.right_shift(at, shift, out=at)
        np.add(at, base, out=at)
        np.take(tables, place, out=keys, mode="clip")
        if len(rare):
            keys[rare] = _sample_keys(place[rare], levels[rare] * math.log(GRID))  # their base is 0
        np.bitwise_xor(keys, low, out=keys)
        out[:, k] = np.minimum.reduceat(keys, begins) & U(0xFFFFFFFF)
    return out


def band_hashes(found: np.ndarray, bands: int) -> np.ndarray:
    by = found.reshape(len(found), bands, -1).astype(U)
    h = np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    h = np.broadcast_to(h, by.shape[:2])
    for i in range(by.shape[2]):
        h = mix(h + by[:, :, i] * U(0xD6E8FEB86659FD93))
    return h


BLOCK = "block long, rows long, ids binary, digests binary, ends binary, tokens binary, words binary"


def blocks(docs: DataFrame) -> DataFrame:
    """A row per block: ids, digests and lengths of its documents (id, text), tokens (places in words) and the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts, words, ends in token_blocks(batches, "alnum", lambda b: as_bytes(b.column(1))):
            different, tokens = np.unique(words, return_inverse=True)
            digests = b"".join(hashlib.sha256(t).digest() for part in parts for t in part.column(1).cast(pa.binary()).to_pylist())
            data = {"block": number, "rows": len(ends), "ids": packed_ids(pa.concat_arrays([p.column(0) for p in parts])), "digests": digests, "ends": small(ends), "tokens": small(tokens), "words": gaps(different)}
            yield pa.record_batch([pa.array([v]) for v in data.values()], list(data))

    return docs.select("id", "text").mapInArrow(trimmed(run), BLOCK)


class Block:
    """A block's distinct shingles (keys), and each document's, ascending: places among keys and counts."""

    def __init__(self, row: dict, n: int):
        words, tokens, ends = from_gaps(row["words"]), from_small(row["tokens"]), from_small(row["ends"])
        hashes = words[tokens]
        doc = np.repeat(np.arange(len(ends)), ends)
        whole = grams(hashes, n)
        within = doc[: len(whole)] == doc[n - 1 :] if len(whole) else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(ends)])
        short = np.flatnonzero((ends > 0) & (ends < n))
        few = [grams(hashes[offsets[i] : offsets[i + 1]], int(ends[i])) for i in short]
        h, doc = np.concatenate([whole[within], *few]), np.concatenate([doc[: len(whole)][within], short])
        self.keys, _, place = distinct(h)
        each, self.counts = np.unique(doc * max(1, len(self.keys)) + place, return_counts=True)
        self.doc, self.place = np.divmod(each, max(1, len(self.keys)))
        self.begins = np.searchsorted(self.doc, np.arange(len(ends) + 1))
        self.ids, self.digests, self.rows = row["ids"], row["digests"], len(ends)

    def weights(self, answers: list[dict], parts: int, total: int, copies: int = Settings.copies) -> np.ndarray:
        df = in_order(answers, self.keys, parts)
        found = idf(df, total)[self.place]
        often = np.bincount(self.doc[(df > copies)[self.place]], minlength=self.rows)
        sizes = np.diff(self.begins)
        for i in np.flatnonzero((sizes > 0) & (2 * often >= sizes)):  # the median is above copies
            a, b = self.begins[i : i + 2]
            found[a:b] = idf(without_copies(df[self.place[a:b]], copies), total)
        return self.counts * found

    def digest(self, i: int) -> bytes:
        return self.digests[32 * i : 32 * i + 32]


@dataclass(frozen=True)
class Corpus:
    """The blocks with the document counts of their shingles (dfs)."""

    known: DataFrame
    parts: int
    total: int
    settings: Settings

    @classmethod
    def of(cls, docs: DataFrame, settings: Settings) -> Corpus:
        found = written(blocks(docs), "shingle-blocks")
        shape, total = Shape.of(found), found.agg({"rows": "sum"}).first()[0] or 0

        def question(row: dict) -> list[Question]:
            block = Block(row, settings.words)
            return [(block.keys, np.bincount(block.place, minlength=len(block.keys)))]

        with small_batches(docs.sparkSession, BLOCK_ROWS):
            answers = answered(ask(found, question, shape.parts), shape, "shingle-counts")
        known = written(found.join(gathered(answers).withColumnRenamed("answers", "dfs"), "block", "left"), "shingles")
        discard(found, answers)
        return cls(known, shape.parts, total, settings)

    def sketches(self) -> DataFrame:
        """Per row: id, digest (of the text), block and at (its place there), samples (one byte each) and bands (hashes); both empty without words."""
        parts, total, settings = self.parts, self.total, self.settings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, settings.words)
                    weights = block.weights(row["dfs"], parts, total, settings.copies)
                    bytes_, bands = [b""] * block.rows, [[]] * block.rows
                    for docs, begins, a, b in block_groups(block):
                        own = samples(block.keys[block.place[a:b]], weights[a:b], begins, settings.samples)
                        hashes = band_hashes(own, settings.bands).view(np.int64)
                        for j, i in enumerate(docs.tolist()):
                            bytes_[i], bands[i] = own[j].astype(np.uint8).tobytes(), hashes[j]
                    digests = [block.digest(i) for i in range(block.rows)]
                    columns = [unpacked_ids(block.ids), pa.array(digests, pa.binary()), pa.array(np.full(block.rows, row["block"])), pa.array(np.arange(block.rows, dtype=np.int32)), pa.array(bytes_, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                    yield pa.record_batch(columns, ["id", "digest", "block", "at", "samples", "bands"])

        return self.known.mapInArrow(trimmed(run), "id long, digest binary, block long, at int, samples binary, bands array<long>")

    def profiles(self, wanted: DataFrame, fine: int = 0) -> DataFrame:
        """Of the wanted (node, block, at): node, its shingles and weights, or with fine so many samples."""
        parts, total, settings = self.parts, self.total, self.settings
        lists = wanted.groupBy("block").agg(F.collect_list(F.struct("at", "node")).alias("wanted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, settings.words)
                    weights = block.weights(row["dfs"], parts, total, settings.copies)
                    at, nodes = np.array([x["at"] for x in row["wanted"]]), pa.array([x["node"] for x in row["wanted"]], pa.int64())
                    begins, ends = block.begins[at], block.begins[at + 1]
                    if fine:
                        order = np.concatenate([np.arange(a, b) for a, b in zip(begins, ends)])
                        own = samples(block.keys[block.place[order]], weights[order], np.cumsum(ends - begins) - (ends - begins), fine)
                        columns = [[x.astype(np.uint8).tobytes() for x in own], [b""] * len(at)]
                    else:
                        columns = [[x[a:b].tobytes() for a, b in zip(begins, ends)] for x in (block.keys[block.place], weights)]
                    yield pa.record_batch([nodes, *(pa.array(c, pa.binary()) for c in columns)], ["node", "own", "weights"])

        return self.known.join(lists, "block").mapInArrow(trimmed(run), "node long, own binary, weights binary")


def block_groups(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Documents with shingles in groups that fit the processor's cache: their numbers, begins in the group, the group's range."""
    full = np.flatnonzero(np.diff(block.begins))
    sizes, at = np.diff(block.begins)[full], 0
    while at < len(full):
        to, size = at, 0
        while to < len(full) and (to == at or size + sizes[to] <= 1 << 15):
            size += sizes[to]
            to += 1
        begin = block.begins[full[at]]
        yield full[at:to], block.begins[full[at:to]] - begin, int(begin), int(begin + size)
        at = to


def like(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that have enough equal samples. A text a has a pair for each band at most; a text b may have any number."""
    own = nodes.select("node", "samples")
    partners = own.select(F.col("node").alias("b"), F.col("samples").alias("y")).join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b")
    rows = pairs.join(own.select(F.col("node").alias("a"), F.col("samples").alias("x")), "a")
    rows = split_join(rows, partners, "b", "n", "a", "inner").select("a", "b", "x", "y")
    least = settings.least(settings.samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yes = (x == y).mean(axis=1) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(yes))

    return rows.mapInArrow(trimmed(run), "a long, b long")


def verified(pairs: DataFrame, corpus: Corpus, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar, with the similarity.

    Texts that share a partner b come in a row behind b's shingles; of many, `members` at a time, so
    that a common partner's texts are spread over all tasks.
    """
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    with small_batches(pairs.sparkSession, BLOCK_ROWS):
        profiles = written(corpus.profiles(nodes.select("node", "block", "at").join(ids, "node")), "profiles")
    turns = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / settings.members).alias("turns"), F.count(F.lit(1)).alias("n"))
    own = profiles.withColumnRenamed("node", "b").join(turns, "b").select("b", F.explode(F.sequence(F.lit(1), F.col("turns"))).alias("turn"), F.lit(None).cast("long").alias("a"), "own", "weights")
    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    theirs = split_join(split_join(pairs, turns, "b", "n", "a", "inner"), profiles.withColumnRenamed("node", "a").join(partners, "a"), "a", "partners", "b", "inner", 16 * settings.members).select("b", (F.pmod(F.xxhash64("a"), "turns") + 1).alias("turn"), "a", "own", "weights")
    rows = own.unionByName(theirs).repartition("b", "turn").sortWithinPartitions("b", "turn", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partner = None
        for batch in batches:
            out = []
            for b, a, own, weights in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "own", "weights"))):
                text = np.frombuffer(own, U), np.frombuffer(weights, np.float64)
                if a is None:
                    partner = text
                elif (score := similarity(text, partner)) >= settings.threshold:
                    out.append((a, b, score))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    links = written(rows.mapInArrow(trimmed(run), "a long, b long, similarity double"), "verified")
    discard(pairs, profiles)
    return links


VISIT = "band long, home int, guest int, node long, label long, minor boolean, visitor boolean, samples binary"


def visits(mixed: DataFrame, settings: Settings) -> DataFrame:
    """Rows of mixed (band, n, rest, node, label, minor, samples) dealt to groups (band, home, guest).

    A group has one block of a bucket's texts, and one block of its visitors: the `rest` texts outside its largest class.
    """
    homes, guests = (F.ceil(F.col(c) / settings.block).cast("int") for c in ("n", "rest"))
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["band", "home", "guest", "node", "label", "minor", "visitor", "samples"]
    stay = mixed.withColumn("home", place(homes, 1)).withColumn("guest", every(guests)).withColumn("visitor", F.lit(False))
    come = mixed.where("minor").withColumn("guest", place(guests, 2)).withColumn("home", every(homes)).withColumn("visitor", F.lit(True))
    return stay.select(*columns).unionByName(come.select(*columns))


def across(rows: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of a visitor and a resident of a group whose classes differ and whose samples are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of a group that may go on
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([table.column(c).to_numpy() for c in ("band", "home", "guest")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges[:-1]], edges):
                yield _across(table.slice(a, b - a), settings)
            held = table.slice(edges[-1]) if len(edges) else table
        if held is not None and held.num_rows:
            yield _across(held, settings)

    dealt = rows.repartition("band", "home", "guest").sortWithinPartitions("band", "home", "guest")
    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def _across(group: pa.Table, settings: Settings) -> pa.RecordBatch:
    """A pair whose both texts visit is taken once, by the visitor with the lesser node."""
    node, label, minor, visitor = (group.column(c).to_numpy() for c in ("node", "label", "minor", "visitor"))
    x = np.frombuffer(b"".join(group.column("samples").to_pylist()), np.uint8).reshape(len(node), -1)
    residents = np.flatnonzero(~visitor)
    out = []
    for i in np.flatnonzero(visitor):
        others = residents[(label[residents] != label[i]) & (~minor[residents] | (node[residents] > node[i]))]
        for size in (settings.samples, settings.fine):
            others = others[(x[others, :size] == x[i, :size]).mean(axis=1) >= settings.least(size)] if len(others) else others
        out += [(min(node[i], node[j]), max(node[i], node[j])) for j in others]
    return pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: id_col, class_id (the least id of its class), text_id (the least id of its text), digest (of its text), first_id and first_digest.

    The latter two are the class's first document: the one with the least id, of several the one with the least digest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    corpus = Corpus.of(docs, settings)
    with small_batches(spark, BLOCK_ROWS):
        rows = written(corpus.sketches(), "sketches")
    # Equal texts are one node; nodes are numbered.
    known = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    nodes = known.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("block", "at")).alias("place"), F.first("samples").alias("samples"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "copies", "place.block", "place.at", "samples", "bands"), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(split_join(bands, sizes.withColumn("m", F.col("n")), "band", "m", "node", "inner"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    central = shared.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top"), F.max("n").alias("m")).select("band", (-F.col("top.minus")).alias("b"), "m")
    stars = split_join(shared, central, "band", "m", "node", "inner").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    stars = written(stars, "stars")
    links = verified(like(stars, nodes, settings), corpus, nodes, settings)
    discard(stars)
    labels = components(links)
    # Buckets that still hold several classes: texts outside the bucket's largest class visit all its blocks.
    own = shared.join(labels, "node", "left").select("node", "band", "n", F.coalesce("label", "node").alias("label"))
    largest = own.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("classes"), F.sum("c").alias("m"))
    largest = largest.where("classes > 1").select("band", F.col("most.c").alias("c"), F.col("most.label").alias("most"), "m")
    mixed = written(split_join(own, largest, "band", "m", "node", "inner"), "mixed")
    discard(shared, labels)
    with small_batches(spark, BLOCK_ROWS):
        wanted = nodes.select("node", "block", "at").join(mixed.select("node").distinct(), "node")
        fine = written(corpus.profiles(wanted, settings.fine).select("node", F.col("own").alias("samples")), "finer")
    found = mixed.join(fine, "node").select("band", "n", (F.col("n") - F.col("c")).alias("rest"), "node", "label", (F.col("label") != F.col("most")).alias("minor"), "samples")
    more = verified(across(visits(found, settings), settings), corpus, nodes, settings)
    labels = components(links.select("a", "b").union(more.select("a", "b")))
    discard(links, more, mixed, fine)
    own = nodes.join(labels, "node", "left").select("digest", "least", "copies", F.coalesce("label", "node").alias("label"))
    first = own.groupBy("label").agg(F.min(F.struct("least", "digest")).alias("first"), F.count(F.lit(1)).alias("texts"))
    classes = split_join(own, first, "label", "texts", "digest").select("digest", "first", "least", "copies")
    discard(corpus.known)

    def named(least: Column, digest: Column) -> Column:
        number = F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")
        return F.when(least == NO_ID, -1 - number).otherwise(least)

    out = split_join(rows.select("id", "digest"), classes, "digest", "copies", "id")
    out = out.select(
        F.col("id").alias(id_col),
        named(F.col("first.least"), F.col("first.digest")).alias("class_id"),
        named(F.col("least"), F.col("digest")).alias("text_id"),
        "digest",
        F.when(F.col("first.least") != NO_ID, F.col("first.least")).alias("first_id"),
        F.col("first.digest").alias("first_digest"),
    )
    out = written(out, "classes")
    discard(rows, nodes, labels)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with one row of each class: its first document (of repeated rows of it, any).

    Rows go by id and digest of the text. Spark decides by the list's size whether docs are shuffled for it.
    """
    found = near_duplicates(docs, id_col, text_col, settings)
    first = (F.col(id_col).eqNullSafe(F.col("first_id"))) & (F.col("digest") == F.col("first_digest"))
    key = lambda c, name: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias(name)
    i, d = ("_" * (1 + max(map(len, docs.columns))) + x for x in "id")  # no column of docs
    listed = found.groupBy(key(id_col, i), F.col("digest").alias(d)).agg(F.count(F.lit(1)).alias("n"), F.first(first).alias("first"))
    listed = written(listed.where("n > 1 or not first"), "classes-left")
    keyed = docs.withColumns({i: key(id_col, i), d: F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))})
    out = keyed.join(listed.select(i, d), [i, d], "left_anti")
    repeated = listed.where("first").select(i, d)
    if repeated.limit(1).count():
        out = out.unionByName(keyed.join(repeated, [i, d], "left_semi").dropDuplicates([i, d]))
    return out.select(*docs.columns)
