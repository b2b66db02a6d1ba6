"""Clustering with zone maps against plain rounds over all vectors."""

import hashlib
import math

import numpy as np
import pytest

from tessella.llm import centroids as c

KIND = "vec_id long, embedding array<double>, label int, v string, cluster string, distance string"


def brute(rows, s):
    kept = [(i, [max(-c.LIMIT, min(c.LIMIT, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == s.length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[: s.clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((apart(v, m), k) for k, m in enumerate(now)) for _, v in kept]
    for _ in range(s.rounds):
        found = assign()
        for k in range(len(now)):
            own = [v for (_, v), (_, j) in zip(kept, found) if j == k]
            if own:
                now[k] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    total = lambda k: min(sum(d for d, j in found if k in (None, j)), c.LONG)
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in now]
    return sorted(((i, k, d, total(k), total(None), sha[k]) for (i, _), (d, k) in zip(kept, found)), key=str)


def result(spark, rows, s):
    df = spark.createDataFrame([(i, v, 1, "v", "c", "d") for i, v in rows], KIND)
    return sorted((tuple(r) for r in c.cluster(df, settings=s).collect()), key=str)


def test_hilbert_curve():
    """All cells of a cube once, each a step from the one before."""
    for n, bits in ((2, 4), (3, 3), (8, 1), (1, 5)):
        axes = np.array(np.meshgrid(*[range(1 << bits)] * n, indexing="ij")).reshape(n, -1).T
        place = c.hilbert(axes, bits)
        assert sorted(place.tolist()) == list(range(1 << n * bits))
        assert (np.abs(np.diff(axes[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_keep_the_nearest():
    """A zone's candidates hold the nearest centroid of each of its vectors; narrow zones have few."""
    rng, few = np.random.default_rng(1), 0
    for spread in (1, 30, 400):
        first = rng.integers(-900, 900, (8, 64))
        axes = c.directions(first)
        assert np.allclose(axes @ axes.T, np.eye(len(axes)))
        moved = first + rng.integers(-60, 60, first.shape)
        for k in range(8):
            x = first[k] + rng.integers(-spread, spread + 1, (40, 64))
            y = x @ axes.T
            yes = c.candidates(x.min(0)[None], x.max(0)[None], y.min(0)[None], y.max(0)[None], moved, axes)[0]
            assert yes[c.distances(x, moved).argmin(1)].all()
            few += yes.sum() == 1
    assert few >= 8


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed):
    """Groups, ties, one vector many times; small blocks, so that zones decide some."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * rng.choice([0.01, 0.5])).tolist()) for i in range(240)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(120)] + [(2000 + i, [float(i % 2), 0.0, 0.0, 0.0, 0.0]) for i in range(20)]
    s = c.Settings(clusters=8, rounds=6, length=5, block=16)
    assert result(spark, rows, s) == brute(rows, s)


def test_odd(spark):
    s = c.Settings(clusters=4, rounds=3, length=3)
    rows = [(1, [0.5, 0.25, -0.125]), (1, [0.5, 0.25, -0.125]), (1, [1.0, 1.0, 1.0]), (None, [2.0, 0.0, 0.0]), (None, [-2.0, 0.0, 0.0]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 0.0, 0.0]), (7, [float("-inf"), 0.0, 0.0]), (8, [1e300, -1e300, 0.0]), (9, [1e6, 2e5, -3e6]), (10, [0.0, -0.0, 1e-300]), (11, [-1e-300, 0.0, 0.0])]
    assert result(spark, rows, s) == brute(rows, s)
    assert result(spark, rows[:2], s) == brute(rows[:2], s)  # fewer vectors than clusters
    assert result(spark, [], s) == result(spark, [(1, None)], s) == []


def test_large_numbers(spark):
    """Exact where products don't fit a float, and sums of distances end at the largest long."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * 40_000).tolist()) for i in range(60)] + [(100 + i, [(-1.0) ** i * 1e9] * 64) for i in range(40)]
    s = c.Settings(rounds=4, block=8)
    assert result(spark, rows, s) == brute(rows, s)
