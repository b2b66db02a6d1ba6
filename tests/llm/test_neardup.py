"""Near-duplicates against all pairs; samples against their collision law; components against a union-find."""

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from tessella.llm import exchange, neardup, queries
from tessella.llm.graph import components
from tessella.llm.neardup import Settings, near_duplicates, samples, similarity

SMALL = "/root/testdata/sf0.001"


def classes_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_weights(docs, n_words=5):
    """TF-IDF by id and shingle, from words alone."""
    own = {}
    for i, t in docs:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        n = min(n_words, len(words))
        own[i] = Counter(tuple(words[j : j + n]) for j in range(len(words) - n + 1)) if n else Counter()
    df = Counter(s for c in own.values() for s in c)
    return {i: {s: c * (1 + math.log((1 + len(docs)) / (1 + df[s]))) for s, c in count.items()} for i, count in own.items()}


def plain_similarity(x, y):
    common = sum(min(w, y[s]) for s, w in x.items() if s in y)
    return common / (sum(x.values()) + sum(y.values()) - common) if common else 0.0


def brute_links(docs, settings=Settings()):
    """Pairs of different texts that are alike, all pairs compared."""
    own = plain_weights(docs, settings.words)
    distinct = list({t or "": i for i, t in reversed(docs)}.values())
    return [(i, j) for x, i in enumerate(distinct) for j in distinct[:x] if plain_similarity(own[i], own[j]) >= settings.threshold]


def brute(docs, settings=Settings()):
    """Classes by id."""
    first = {}
    return classes_of(brute_links(docs, settings) + [(first.setdefault(t or "", i), i) for i, t in docs], [i for i, _ in docs])


def got(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_query(spark, texts):
    assert got(queries.op5_near_duplicates(spark, SMALL)) == brute(texts)


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    docs = [[word() for _ in range(rng.randint(6, 120))] for _ in range(60)]
    for _ in range(4):  # groups with a centre, of which many members are alike only by way of it
        centre = [word() for _ in range(100)]
        for _ in range(25):
            copy = list(centre)
            for _ in range(rng.choice([1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
        docs.append(centre)
    chain = [word() for _ in range(120)]
    for i in range(0, 60, 3):  # each like the next one only
        chain = chain[3:] + [word() for _ in range(3)]
        docs.append(chain)
    docs += [list(d) for d in docs[:20]]
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("block", [512, 7])
def test_groups_and_chains(spark, block):
    docs = corpus(random.Random(6))
    want = brute(docs)
    found = got(near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, band int").repartition(5), settings=replace(Settings(), block=block)))
    pairs = lambda c: {(i, j) for i in c for j in c if i < j and c[i] == c[j]}
    want, found = pairs(want), pairs(found)
    assert found <= want and len(found) >= 0.97 * len(want)


@pytest.mark.parametrize("slice_blocks", [4096, 2])
def test_document_counts(spark, texts, slice_blocks, monkeypatch):
    """Every shingle's count over all blocks and partitions comes back to each block that has it."""
    monkeypatch.setattr(exchange, "SLICE_BLOCKS", slice_blocks)
    docs = spark.createDataFrame(texts, "id long, text string").repartition(9)
    corpus = neardup.Corpus.of(docs, Settings())
    assert corpus.total == len(texts) and corpus.known.count() > 3
    found = {}
    for row in corpus.known.collect():
        row = row.asDict(recursive=True)
        block = neardup.Block(row, 5)
        weights = block.weights(row["dfs"], corpus.parts, corpus.total)
        for i, own in enumerate(exchange.unpacked_ids(block.ids).to_pylist()):
            found[own] = sorted(weights[block.begins[i] : block.begins[i + 1]].tolist())
    want = {i: sorted(w.values()) for i, w in plain_weights(texts).items()}
    assert found.keys() == want.keys() and all(np.allclose(found[i], want[i]) for i in want)


def test_collision_share_is_weighted_jaccard():
    rng = np.random.default_rng(8)
    common, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 60, 90))
    weight = {h: 1.3 + (i % 7) for i, h in enumerate(common.tolist())}
    texts = []
    for own in (x, y):
        h = np.sort(np.concatenate([common, own]))
        texts.append((h, np.array([weight.get(v, 5.0) for v in h.tolist()]) * np.where((h % np.uint64(3) == 0) & (own is x), 2, 1)))
    begins = np.array([0, len(texts[0][0])])
    found = samples(np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]), begins, 4000)
    assert abs((found[0] == found[1]).mean() - similarity(*texts)) < 0.03
    heavy = [(t[0], t[1] * 1000) for t in texts]  # weights above the tables
    found = samples(np.concatenate([t[0] for t in heavy]), np.concatenate([t[1] for t in heavy]), begins, 4000)
    assert abs((found[0] == found[1]).mean() - similarity(*texts)) < 0.03


def test_visits_bring_all_pairs_together(spark):
    """Blocks of residents and visitors: each pair of which one is outside the largest class meets in a group."""
    rows = [(b, n, n - n // 2, b * 1000 + i, i % 7 if i >= n // 2 else 0, i >= n // 2, bytes(8)) for b, n in ((1, 40), (2, 9), (3, 3)) for i in range(n)]
    mixed = spark.createDataFrame(rows, "band long, n long, rest long, node long, label long, minor boolean, samples binary")
    groups = {}
    for r in neardup.visits(mixed, replace(Settings(), block=4)).collect():
        groups.setdefault((r.band, r.home, r.guest), []).append(r)
    met = {(v.node, r.node) for g in groups.values() for v in g if v.visitor for r in g if not r.visitor}
    assert met == {(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[5]}
    assert len(groups) > 30 and max(map(len, groups.values())) < 25


def test_recall_of_near_copies(spark):
    """Links found among texts with random word edits, by the similarity of the pair (independently computed weights)."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    docs = []
    for _ in range(150):
        own = [word() for _ in range(rng.randint(60, 400))]
        copy = [word() if rng.random() < 0.012 else w for w in own]
        docs += [" ".join(own), " ".join(copy)]
    docs = list(enumerate(docs))
    links, found = brute_links(docs), got(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert len(links) > 60 and sum(found[i] == found[j] for i, j in links) >= 0.98 * len(links)
    equal = sum(docs[2 * i][1] == docs[2 * i + 1][1] for i in range(150))
    assert sum(found[2 * i] == found[2 * i + 1] for i in range(150)) <= len(links) + equal


def weights_without_copies(docs, copies):
    """plain_weights where of a text's own copies so many count at most and nothing in it is rarer: the median count of its shingles tells how many there are."""
    own, total = plain_weights(docs), len(docs)
    words = {i: [tuple(w[j : j + 5]) for j in range(len(w) - 4)] for i, w in ((i, re.findall(rb"[0-9a-z]+", t.encode())) for i, t in docs)}
    df = Counter(s for i in words for s in set(words[i]))
    out = {}
    for i, found in own.items():
        median = sorted(df[s] for s in found)[len(found) // 2]
        less = {s: max(copies, df[s] - (median - copies)) if median > copies else df[s] for s in found}
        out[i] = {s: words[i].count(s) * (1 + math.log((1 + total) / (1 + n))) for s, n in less.items()}
    return out


def test_copies_in_a_large_group(spark):
    """However many copies a text has, edited ones are found: what they share counts as much as in a small group."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    original = [word() for _ in range(300)]
    group = [original] * 50
    for edits in [2, 4, 6] * 40 + [9, 14] * 30:
        copy = list(original)
        for at in rng.sample(range(5, 295), edits):
            copy[at] = word()
        group.append(copy)
    docs = list(enumerate(" ".join(d) for d in group + [[word() for _ in range(60)] for _ in range(250)]))
    found = got(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    assert all(found[i] == 0 for i in range(50 + 120))
    own = weights_without_copies(docs, Settings().copies)
    links = [(i, j) for i in range(49, len(group)) for j in range(49, i) if plain_similarity(own[i], own[j]) >= 0.8]
    want = classes_of(links + [(i, 0) for i in range(50)], range(len(docs)))
    assert sum(found[i] == found[0] for i in found) == sum(want[i] == want[0] for i in want) < len(group)
    by_rows = plain_weights(docs)
    assert sum(plain_similarity(by_rows[i], by_rows[0]) >= 0.8 for i in range(50, 50 + 120)) <= 40


def test_without_copies():
    df = np.array([1, 2, 40, 1000, 1003, 999, 1000, 70_000, 1000, 1])
    assert neardup.without_copies(df, 32).tolist() == [32, 32, 32, 32, 35, 32, 32, 69_032, 32, 32]
    for same in ([5, 9, 31, 32], [1, 1, 1, 500], [1]):  # no large group
        assert neardup.without_copies(np.array(same), 32).tolist() == same
    assert neardup.without_copies(np.array([33]), 32).tolist() == [32]


def test_equal_ids_with_different_texts_stay(spark):
    rows = [(1, "one text of its own about a river and a mill"), (1, "quite another text on the price of salt in spring"), (2, "a third text, unlike both"), (2, "a third text, unlike both"), (3, "a third text, unlike both"), (-5, "x y z"), (None, "x y z"), (None, "alone"), (None, "alone"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string")
    left = [(r.doc_id, r.text) for r in neardup.deduplicated(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (-5, "x y z"), (None, "alone"), (9, "")], key=str)
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows) and len({bytes(r.first_digest) for r in found}) == 6
    assert {r.class_id for r in found if r.doc_id == -5} == {-5}
    alone = -1 - int(hashlib.sha256(b"alone").hexdigest()[:15], 16)
    assert [r.class_id for r in found if r.class_id < -5] == [alone, alone]


def test_components(spark):
    rng = random.Random(9)
    nodes = rng.sample(range(10_000), 300)
    edges = list(zip(nodes[:100], nodes[1:100])) + [(nodes[100], n) for n in nodes[101:180]] + [(rng.choice(nodes[180:]), rng.choice(nodes[180:])) for _ in range(60)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes_of(edges, nodes)
    assert all(found.get(n, n) == want[n] for n in nodes)


def test_odd(spark, odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_duplicates(none).count() == 0
    assert {r.doc_id: r.class_id for r in rows if r.doc_id in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 3, 4: 4}
