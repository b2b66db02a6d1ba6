"""Clustering by centroids, with zone maps of blocks along a Hilbert curve.

Vectors become integers floor(1024 * x) and get a place on a Hilbert curve through the eight directions that
the first centroids span; rows are ordered by it (ties by a hash of the id, so that many equal vectors go to many
tasks) and cut into blocks of `block` rows. A block is one row: its ids, its integers, and its zone: least
and largest values of the 64 components and of the eight directions, the components' sums and the number of vectors.

In each round a zone bounds how much nearer centroid j is than centroid k for any vector in its box, from
below and above; k is no candidate if some j is nearer for all of it. A block with one candidate adds
its sums without a look at its vectors; in others each vector is compared with the candidates, exactly, by
whole-number matrix products. The driver gets clusters x components sums a round and sends the new centroids.

Defined cases: null vectors, those of another length, or with null or non-finite components are left out; the
integers are held within +-2^27, so that all distances fit; sums of distances are held at the largest long; with
fewer vectors than clusters there are as many clusters as vectors; of ids with equal hashes (repeated or null
ids, null as an empty text) the least vectors come first; rows with equal ids and vectors are rows of their own; no
vector gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import bounded_batches, discard, small_batches, written

LIMIT = 1 << 27
LONG = (1 << 63) - 1
#: Products and sums of whole numbers below this are exact in floating point.
EXACT = 1 << 52
DIRECTIONS, BITS = 8, 8


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    rounds: int = 10
    length: int = 64
    block: int = 512
    seed: int = 3


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates of so many bits; dimensions x bits are 64 at most."""
    x = axes.astype(np.uint64).T.copy()
    one, n = np.uint64(1), len(x)
    for q in range(bits - 1, 0, -1):  # turn and mirror the smaller cubes into the first one's frame
        bit, low = one << np.uint64(q), (one << np.uint64(q)) - one
        for i in range(n):
            on = x[i] & bit != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (one << np.uint64(q)) != 0, (one << np.uint64(q)) - one, np.uint64(0))
    x ^= turn
    place = np.zeros_like(x[0])
    for q in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << one | (x[i] >> np.uint64(q)) & one
    return place


def directions(first: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the differences of the first centroids, and their own direction."""
    d = first.astype(float)
    base = np.concatenate([d[1:] - d[0], d[:1]])[:DIRECTIONS]
    base = np.concatenate([base, np.eye(first.shape[1])])
    out: list[np.ndarray] = []
    for v in base:
        for w in out:
            v = v - (v @ w) * w
        if (size := np.sqrt(v @ v)) > 1e-6 * max(1.0, np.abs(d).max()):
            out.append(v / size)
        if len(out) == min(DIRECTIONS, first.shape[1]):
            break
    return np.array(out)


def places(x: np.ndarray, axes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signed longs in the order of the Hilbert curve, over the box of the first centroids and half its width around it."""
    y, c = x @ axes.T, first @ axes.T
    low, high = c.min(0), c.max(0)
    wide = np.maximum(high - low, 1.0)
    at = np.clip((y - low + wide / 2) / (2 * wide), 0, 1) * ((1 << BITS) - 1)
    return (hilbert(np.rint(at).astype(np.int64), BITS) ^ np.uint64(1 << 63)).view(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, y_low: np.ndarray, y_high: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Zones x centroids: whether a vector in the zone's boxes may have that nearest centroid (ties included).

    |x - k|^2 - |x - j|^2 is linear in x: its least value over a box is the sum over coordinates. What the
    directions take of its slope is bounded by their box, the rest by that of the components.
    """
    c = centroids.astype(float)
    yes = np.ones((len(low), len(c)), bool)
    reach = np.maximum(np.abs(low), np.abs(high)).sum(1) + np.maximum(np.abs(y_low), np.abs(y_high)).sum(1)
    for k in range(len(c)):
        for j in range(len(c)):
            if j == k:
                continue
            slope = 2 * (c[j] - c[k])
            own = axes @ slope
            rest = slope - own @ axes
            least = np.minimum(low * rest, high * rest).sum(1) + np.minimum(y_low * own, y_high * own).sum(1) + (c[k] @ c[k] - c[j] @ c[j])
            margin = 1e-9 * (1 + reach * np.abs(slope).max() + c[k] @ c[k] + c[j] @ c[j])
            yes[:, k] &= ~(least > margin)
    return yes


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    if 4 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c.astype(np.int64)) ** 2).sum(1) for c in centroids], 1)



def whole_numbers(vector: Column, length: int) -> Column:
    """floor(1024 * x) of usable vectors, else null."""
    good = (F.size(vector) == length) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # The limits come first: floor gives a long.
    number = lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-LIMIT / 1024.0)), F.lit(LIMIT / 1024.0)) * 1024).cast("int")
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, number))


ZONE = "ids binary, vectors binary, n long, low array<int>, high array<int>, y_low array<double>, y_high array<double>, sums array<long>"
KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]


def blocks(vectors: DataFrame, first: np.ndarray, axes: np.ndarray, s: Settings) -> DataFrame:
    """Blocks of (id, v) along the curve, written."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, s.length)
            found = places(x.astype(float), axes, first) if len(x) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(found)], ["id", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, s.block):
                part = batch.slice(at, s.block)
                x = part.column("v").flatten().to_numpy().reshape(-1, s.length)
                known = part.column("id").is_valid().to_numpy(zero_copy_only=False)
                ids = np.stack([part.column("id").fill_null(0).to_numpy(), known.astype(np.int64)])
                y = x @ axes.T
                row = [ids.tobytes(), x.astype(np.int32).tobytes(), len(x), x.min(0), x.max(0), y.min(0), y.max(0), x.sum(0, dtype=np.int64)]
                yield pa.record_batch([pa.array([v.tolist() if isinstance(v, np.ndarray) else v], t) for v, t in zip(row, KINDS)], names=[f.split()[0] for f in ZONE.split(", ")])

    bounded_batches(vectors.sparkSession, 8 * s.block)
    rows = vectors.mapInArrow(placed, "id long, v array<int>, place long").withColumn("spread", F.xxhash64("id", "v"))
    rows = rows.repartitionByRange("place", "spread").sortWithinPartitions("place", "spread").select("id", "v")
    with small_batches(vectors.sparkSession, 8 * s.block):
        return written(rows.mapInArrow(cut, ZONE), "zones")


def zones(batch: pa.RecordBatch, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    own = lambda c: np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1)
    return candidates(own("low"), own("high"), own("y_low"), own("y_high"), centroids, axes)


def _nearest(data: bytes, some: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, nearest of the candidates, squared distances to it)."""
    x = np.frombuffer(data, np.int32).reshape(-1, centroids.shape[1])
    d = distances(x, centroids[some])
    best = d.argmin(1)
    return x, some[best], d[np.arange(len(x)), best]


def _long_sum(values: Column) -> Column:
    return F.sum(values.cast("decimal(20,0)"))


def totals(found: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(vectors of each cluster, sums of their components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, length = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            yes = zones(batch, centroids, axes)
            for i, some in enumerate(map(np.flatnonzero, yes)):
                if len(some) == 1:
                    counts[some[0]] += batch.column("n")[i].as_py()
                    sums[some[0]] += np.array(batch.column("sums")[i].as_py(), np.int64)
                else:
                    x, nearest, _ = _nearest(batch.column("vectors")[i].as_py(), some, centroids)
                    for c in some.tolist():
                        counts[c] += int((nearest == c).sum())
                        sums[c] += x[nearest == c].sum(0, dtype=np.int64)
        rows = [pa.array(np.repeat(np.arange(k, dtype=np.int32), length + 1)), pa.array(np.tile(np.arange(length + 1, dtype=np.int32), k)), pa.array(np.concatenate([sums, counts[:, None]], 1).ravel())]
        yield pa.record_batch(rows, ["cluster", "place", "total"])

    k, length = centroids.shape
    rows = found.drop("ids").mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(_long_sum(F.col("total")).alias("total")).collect()
    out = np.zeros((k, length + 1), object)
    for r in rows:
        out[r.cluster, r.place] = int(r.total)
    return out[:, length].tolist(), out[:, :length].tolist()


def assigned(found: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, some in enumerate(map(np.flatnonzero, zones(batch, centroids, axes))):
                _, nearest, d = _nearest(batch.column("vectors")[i].as_py(), some, centroids)
                ids, known = np.frombuffer(batch.column("ids")[i].as_py(), np.int64).reshape(2, -1)
                yield pa.record_batch([pa.array(ids, mask=known == 0), pa.array(nearest.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return found.select("ids", "vectors", *(c for c in ("low", "high", "y_low", "y_high"))).mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, s: Settings) -> np.ndarray:
    """The vectors with the least hashes of the seed and the id."""
    order = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(s.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, s.length)


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """Per usable vector: id_col, cluster int, distance long, cluster_inertia and inertia long, centroid_sha256 string."""
    spark, s = table.sparkSession, settings
    vectors = table.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), s.length).alias("v")).where("v is not null")
    centroids = first_centroids(vectors, s)
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(centroids):
        return vectors.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in zip(names, ("int", "long", "long", "long", "string"))))
    axes = directions(centroids)
    found = blocks(vectors, centroids, axes, s)
    for _ in range(s.rounds):
        counts, sums = totals(found, centroids, axes)
        moved = [[x // n for x in row] if n else old for n, row, old in zip(counts, sums, centroids.tolist())]
        if moved == centroids.tolist():
            break  # further rounds would repeat this one
        centroids = np.array(moved, np.int64)
    own = written(assigned(found, centroids, axes), "assigned")
    discard(found)
    parts = {r.cluster: int(r.d) for r in own.groupBy("cluster").agg(_long_sum(F.col("distance")).alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    held = lambda n: min(n, LONG)
    facts = [(i, held(parts.get(i, 0)), held(sum(parts.values())), h) for i, h in enumerate(hashes)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *names)
