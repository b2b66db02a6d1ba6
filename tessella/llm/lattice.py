"""Near-duplicates of embeddings by lattice hashing.

Each of `tables` tables projects the unit vectors onto `blocks` times eight random directions and decodes
each eight to the nearest point of the E8 lattice (stretched by `scale`); a vector lives in the cell of its
points and looks into the `probes` neighbouring cells whose borders are nearest. Two vectors are candidates
if any of their cells are the same; a candidate pair with equal labels and lengths is linked if its cosine in
double precision is `threshold` or more.

Equal vectors of a label are one node with a count. First only (cell, node) is shuffled: cells with one node
go, and of the cells with exactly the same nodes one stays. Only then the vectors are sent to what is left, where
they meet in blocks (see meet): a group's Gram matrix gives its links; a pair that an earlier common cell has
as well isn't counted again. A group returns one row a vector (its links and the least vector it hangs
together with), never pairs. Components come from these rows.

Pairs of cosine 0.98 of directions without structure share a cell with probability 0.99, of 0.985 0.997.
A cell that many nodes share costs as many comparisons as it has pairs, in groups of two blocks at most.

Defined cases: null, empty and zero vectors, those with null or non-finite components and those with a null label
have no links and are their own component; vectors of different lengths have no links; equal rows are
vectors of their own, linked; a null id counts as larger than all others, and such a row isn't kept; an empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.graph import components
from tessella.llm.meet import BLOCK, by_group, dealt, sizes, with_sizes
from tessella.llm.skew import split_join
from tessella.llm.storage import bounded_batches, discard, written
from tessella.llm.wordhash import U, mix

NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    tables: int = 4
    blocks: int = 2
    probes: int = 5
    scale: float = 1.1
    block: int = BLOCK
    seed: int = 11


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    whole = [[a * (i == k) + b * (j == k) for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half], float)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum: the worst rounded one goes the other way if need be."""
    near = np.rint(x)
    odd, rows = near.sum(1) % 2 != 0, np.arange(len(x))
    worst = np.abs(x - near).argmax(1)
    near[rows, worst] += np.where(odd, np.where(x[rows, worst] >= near[rows, worst], 1, -1), 0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for each row of eight coordinates."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


@cache
def _projection(length: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions and offsets of all blocks of all tables, and odd multipliers that hash their points."""
    rng, n = np.random.default_rng([s.seed, length]), s.tables * s.blocks * 8
    return rng.normal(size=(length, n)) / s.scale, rng.random(n) * 2, rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def cells(units: np.ndarray, s: Settings) -> np.ndarray:
    """Per unit vector the hashes of its own and of the probed cells, of one table after the other."""
    directions, offsets, odd = _projection(units.shape[1], s)
    x, out = units @ directions + offsets, []
    halves = lambda points: np.rint(points * 2).astype(np.int64).view(U)
    for t in range(s.tables):
        own, gains, steps = np.full(len(x), t, U), [], []
        for b in range(s.blocks):
            at = slice((t * s.blocks + b) * 8, (t * s.blocks + b + 1) * 8)
            points = nearest(x[:, at])
            own = own + (halves(points) * odd[at]).sum(1, dtype=U)
            gains.append((x[:, at] - points) @ roots().T)
            steps.append((halves(roots()) * odd[at]).sum(1, dtype=U))
        out.append(mix(own)[:, None])
        if s.probes:
            gain = np.concatenate(gains, 1)
            best = np.argpartition(-gain, s.probes - 1, axis=1)[:, : s.probes]
            out.append(mix(own[:, None] + np.concatenate(steps)[best]))
    return np.concatenate(out, 1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; the largest component is brought to 1 first, so that nothing overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length."""
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    begins = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[begins[rows][:, None] + np.arange(n)]


def usable(vector: Column, label: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def _links(batch: pa.RecordBatch, inside: bool, threshold: float) -> pa.RecordBatch | None:
    """Per row of a group with a link: hash, how many vectors it is linked to here first, and the least (id, hash) it hangs together with."""
    ids, hashes, copies = (batch.column(c).to_numpy() for c in ("id", "hash", "copies"))
    cell, left = batch.column("cell")[0].as_py(), batch.column("left").to_numpy(zero_copy_only=False)
    label, lists = batch.column("label"), batch.column("cells")
    codes = label.dictionary_encode().indices.to_numpy()
    near = np.zeros((len(ids), len(ids)), bool)
    for rows, vectors in by_length(batch.column("vector")):
        u = units(vectors)
        near[np.ix_(rows, rows)] = u @ u.T >= threshold
    near &= codes[:, None] == codes
    near &= (left[:, None] | left) if inside else (left[:, None] != left)
    near &= (ids[:, None] != ids) | (hashes[:, None] != hashes)
    linked = np.flatnonzero(near.any(1))
    if not len(linked):
        return None
    near = near[np.ix_(linked, linked)]
    # Which of the pairs an earlier common cell has, too: products of the rows' memberships in the earlier cells.
    earlier, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
    place = np.full(len(ids), -1)
    place[linked] = np.arange(len(linked))
    yes = (earlier < cell) & (place[rows] >= 0)
    names, which, often = np.unique(earlier[yes], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(often > 1)
    column = np.full(len(names), -1)
    column[twice] = np.arange(len(twice))
    member = np.zeros((len(linked), len(twice)), np.float32)
    both = column[which] >= 0
    member[place[rows[yes]][both], column[which][both]] = 1
    new = near & (member @ member.T < 0.5)
    counts = new @ copies[linked]
    order = np.lexsort((hashes[linked], ids[linked]))
    rank = np.empty(len(linked), np.int64)
    rank[order] = np.arange(len(linked))
    while True:  # the least rank along links
        step = np.minimum(rank, np.where(near, rank, len(linked)).min(1))
        if (step == rank).all():
            break
        rank = step
    least = linked[order[rank]]
    return pa.record_batch([ids[linked], hashes[linked], counts, ids[least], hashes[least]], ["id", "hash", "links", "to_id", "to_hash"])


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """Per row: id_col, n_links long (other rows linked directly), component_id (the least id reachable by links) and kept."""
    spark, s = table.sparkSession, settings
    bounded_batches(spark, 4096)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    known = F.coalesce("id", F.lit(NO_ID))
    plain = lambda x: x + F.lit(0).cast("float")  # noqa: E731  -0 becomes 0
    good = rows.where(usable(F.col("vector"), F.col("label"))).withColumn("vector", F.transform("vector", plain))
    name = lambda vector: F.struct(*(F.xxhash64(F.lit(i), "label", vector).alias(c) for i, c in enumerate(("hash", "more"))))
    nodes = good.groupBy("label", "vector").agg(F.min(known).alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select(name(F.col("vector")).alias("name"), "id", "copies", "label", "vector").select("name.hash", "*"), "vectors")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, labels = batch.column("hash").to_numpy(), batch.column("label_hash").to_numpy().view(U)
            for at, vectors in by_length(batch.column("vector")):
                found = mix(cells(units(vectors), s) + mix(labels[at] + U(vectors.shape[1]))[:, None]).view(np.int64)
                yield pa.record_batch([found.ravel(), np.repeat(own[at], found.shape[1])], ["cell", "hash"])

    members = nodes.select("hash", "vector", F.xxhash64("label").alias("label_hash")).mapInArrow(hashes, "cell long, hash long")
    members = written(members, "cells")
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "hash"))
    shared = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    once = written(shared.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "n", F.col("n").alias("homes")), "shared-cells")
    mine = with_sizes(members.withColumn("spread", F.col("hash")), once).groupBy("hash").agg(F.collect_list(F.struct("cell", "n")).alias("at"))
    sent = nodes.join(mine, "hash").select("hash", "id", "copies", "label", "vector", F.col("at.cell").alias("cells"), F.explode("at").alias("c"))
    sent = sent.select("hash", "id", "copies", "label", "vector", "cells", "c.cell", "c.n", F.col("c.n").alias("homes"), F.lit(True).alias("home"), F.col("hash").alias("spread"))
    work = by_group(lambda batch, inside: _links(batch, inside, s.threshold))
    links = written(dealt(sent, s.block).mapInArrow(work, "id long, hash long, links long, to_id long, to_hash long"), "vector-links")
    discard(members, once)
    node = lambda i, h: F.struct(F.col(i).alias("id"), F.col(h).alias("hash"))
    labels = components(links.select(node("id", "hash").alias("a"), node("to_id", "to_hash").alias("b")))
    counts = links.groupBy(node("id", "hash").alias("node")).agg(F.sum("links").alias("links"))
    found = counts.join(labels, "node").select("node", "links", F.col("label.id").alias("first"))
    own = nodes.select(node("id", "hash").alias("node"), "name", "id", "copies")
    found = own.join(found, "node", "left").where("copies > 1 or links is not null")
    found = found.select("name", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "id").alias("first"))
    found = written(found, "vector-classes")
    discard(nodes, links, labels)
    named = F.when(usable(F.col("vector"), F.col("label")), name(F.transform("vector", plain)))
    out = split_join(rows.select("id", named.alias("name")), found, "name", "copies", "id")
    first = F.coalesce(F.when(F.col("first") != NO_ID, F.col("first")), "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"), F.coalesce(F.col("id") == first, F.lit(False)).alias("kept"))
