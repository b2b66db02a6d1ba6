"""Lattice hashing of embeddings against all pairs."""

import math
from itertools import product

import numpy as np
import pytest

from tessella.llm import lattice, meet, queries

SMALL = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, name string, cell long, hash long, links int"


def brute(rows):
    """vec_id, n_links and component_id of each row, by its place."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v, _), g in zip(rows, good)]
    linked = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(known) if known else None
        out.append((rows[i][0], len(linked[i]), first, rows[i][0] is not None and rows[i][0] == first))
    return sorted(out, key=str)


def result(spark, rows, settings=lattice.Settings()):
    df = spark.createDataFrame([(i, v, label, "n", 1, 2, 3) for i, v, label in rows], KIND)
    return sorted((tuple(r) for r in lattice.near_vectors(df, settings=settings).collect()), key=str)


def near(rng, v, cosine):
    noise = rng.normal(size=len(v))
    noise -= noise @ v * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


def corpus(seed, length=64):
    """Groups, chains and copies; half of the pairs just above the threshold or under it."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(25):
            rows.append(rng.normal(size=length))
        for _ in range(6):
            centre = rng.normal(size=length)
            rows += [centre * 3] + [near(rng, centre, rng.choice([0.999, 0.995, 0.992])) for _ in range(rng.integers(1, 9))]
        chain = rng.normal(size=length)
        for _ in range(6):
            chain = near(rng, chain, 0.988)
            rows.append(chain)
        rows += [rows[-1], rows[-1], rows[-1] * 2]
    order = rng.permutation(len(rows))
    return [(int(1000 + i), rows[k].astype(np.float32).tolist(), int(k * 3 // len(rows))) for i, k in enumerate(order)]


def test_lattice_points():
    """The nearest of all points near by; the roots are the shortest vectors."""
    rng = np.random.default_rng(1)
    points = np.array([p for p in product((-1, 0, 1), repeat=8) if sum(p) % 2 == 0] + [tuple(x + 0.5 for x in p) for p in product((-1, 0), repeat=8) if (sum(p) + 4) % 2 == 0], float)
    x = rng.uniform(-0.5, 0.5, (40, 8))
    found = lattice.nearest(x)
    assert np.allclose(((x - found) ** 2).sum(1), ((x[:, None] - points) ** 2).sum(2).min(1))
    assert len(np.unique(lattice.roots(), axis=0)) == 240 and np.allclose((lattice.roots() ** 2).sum(1), 2)
    assert np.allclose(lattice.nearest(lattice.roots() * 1.2), lattice.roots())


def test_recall_of_cells():
    """Pairs at the threshold and a little above it share a cell; unlike ones don't."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    own = lattice.cells(a, lattice.Settings())
    shares = lambda b: np.mean([bool(set(x) & set(y)) for x, y in zip(own.tolist(), lattice.cells(b, lattice.Settings()).tolist())])
    assert shares(np.stack([near(rng, v, 0.98) for v in a])) > 0.97 and shares(np.stack([near(rng, v, 0.985) for v in a])) > 0.99
    assert shares(a[rng.permutation(len(a))]) < 0.01


@pytest.mark.parametrize("block", [512, 3])
def test_equals_all_pairs(spark, block):
    """No link without the cosine, and nine tenths of the links at least: of these vectors all."""
    rows = corpus(512)
    assert result(spark, rows, lattice.Settings(block=block)) == brute(rows)


def test_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [float("inf"), 2.0, 3.0], 1), (None, v, 1), (None, [5.0, -1.0, 0.5], 1), (None, [5.0, -1.0, 0.5], 1), (11, [1.0, 2.0, 3.0, 0.0], 1), (12, [-0.0, 1.0, 0.0], 3), (13, [0.0, 1.0, -0.0], 3), (14, [3e38, 1e38, 0.0], 4), (15, [3.1e38, 1e38, 0.0], 4), (16, [1e-40, 0.0, 0.0], 4), (17, [2e-40, 0.0, 0.0], 4)]
    rows = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x], label) for i, x, label in rows]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, [(1, None, None)]) == [(1, 0, 1, True)]
    doubles = spark.createDataFrame([(1, [1e200, 1e200], "a"), (2, [1e-200, 1.01e-200], "a")], "i long, v array<double>, l string")
    assert sorted(map(tuple, lattice.near_vectors(doubles, "i", "v", "l").collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_a_large_group(spark):
    """Many near vectors and many equal ones, met in small blocks: all links are counted."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, near(rng, centre, 0.997).astype(np.float32).tolist(), 1) for i in range(150)] + [(200 + i, [1.0] * 16, 1) for i in range(150)]
    assert result(spark, rows, lattice.Settings(block=16)) == brute(rows)


def test_groups_hold_each_pair_once(spark):
    """Homes meet each other and all visitors, once; visitors don't meet."""
    for homes, visitors, block in ((1, 0, 4), (2, 3, 4), (9, 0, 4), (10, 23, 4), (0, 5, 4), (5, 1, 4)):
        rows = spark.range(homes + visitors).selectExpr("7L as cell", "id as spread", "id as name", f"id < {homes} as home")
        from pyspark.sql import functions as F

        found = meet.with_sizes(rows, meet.sizes(rows, F.col("home")))
        groups = {}
        for r in meet.dealt(found, block).collect():
            groups.setdefault((r.a, r.b), []).append((r.name, r.left))
        pairs = []
        for (a, b), members in groups.items():
            left, right = [n for n, side in members if side], [n for n, side in members if not side]
            assert len(left) <= 4 * block and len(right) <= 4 * block
            pairs += [frozenset((x, y)) for x in left for y in right] + [frozenset((x, y)) for x in left for y in left if a == b and x < y]
        want = {frozenset((x, y)) for x in range(homes) for y in range(homes + visitors) if x != y}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_query(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted((tuple(r) for r in queries.op11_lattice(spark, SMALL).collect()), key=str) == brute(rows)
