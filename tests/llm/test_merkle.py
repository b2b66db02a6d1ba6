"""Merkle fingerprints against a plain rendering of the contract, byte by byte."""

import hashlib
import random
import time
from collections import Counter

from tessella.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"
BLANK = b" \t\n\r\x0b\x0c"


def edited(a, b):
    h = len(a) // 2
    return a[: len(a) - h] + b[:h]


def digest(data):
    return hashlib.sha256(data).digest()


def plain_leaves(data):
    factors = [0x9E3779B1 * (2 * i + 1) % 2**32 | 1 for i in range(8)]
    out, at = [], 0
    for i in range(len(data)):
        before = data[max(0, i - 8) : i][::-1]
        cut = data[i] == 10
        if i and data[i] in BLANK and data[i - 1] not in BLANK:
            cut |= (sum(b * f for b, f in zip(before, factors)) >> 20) % 8 == 0
        if cut:
            out.append(data[at : i + 1])
            at = i + 1
    return [*out, data[at:]] if at < len(data) else out


def plain(text):
    """(fingerprint, leaves as (hash, code points) by section)."""
    data, groups, start = text.encode(), [[]], True
    for leaf in plain_leaves(data):
        if start and leaf.startswith(b"#") and groups[-1]:
            groups.append([])
        groups[-1].append((digest(leaf), len(leaf.decode())))
        if digest(leaf)[0] < 16 or (start and not leaf.strip()):
            groups.append([])
        start = leaf.endswith(b"\n")
    groups = [g for g in groups if g]
    sections = [digest(b"s" + b"".join(h for h, _ in g)) for g in groups]
    tree = digest(b"r" + b"".join(sections)).hex()
    return tree + "".join("/" + s.hex()[:16] + "".join("." + h.hex()[:8] + format(n, "x") for h, n in g) for s, g in zip(sections, groups)), groups


def plain_likeness(a, b):
    """Without sections: the leaves' weighted Jaccard similarity."""
    if a == b:
        return 1.0
    x, y = (Counter(leaf for g in plain(t)[1] for leaf in g) for t in (a, b))
    common = sum(n * min(c, y[h, n]) for (h, n), c in x.items())
    return common / max(len(a) + len(b) - common, common + 1)


def check(rows, docs):
    """docs: (id, text), ids unique."""
    docs = sorted(docs, key=lambda x: -x[0])
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        e = edited(t, after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), plain(t)[0])
        assert r.edited_fingerprint == plain(e)[0]
        assert abs(r.near_edited - plain_likeness(t, e)) < 1e-12
        assert abs(r.near_next - plain_likeness(t, after)) < 1e-12


def test_query(spark, texts):
    rows = queries.op4_merkle(spark, SMALL).collect()
    check(rows, texts)
    long = [r for r in rows if r.n_chars > 400 and r.near_next < 1]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_many_ranges(spark):
    docs = [(i * 7 % 1009, f"text {i} é🎉\nline {i % 5}\n\n# head {i % 3}\nmore words {i % 11} here") for i in range(1009)]
    check(merkle.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(13)).collect(), docs)


def test_one_row_and_ties(spark):
    one = spark.createDataFrame([(5, "ab")], "doc_id long, text string")
    check(merkle.compare_with_next(one).collect(), [(5, "ab")])
    ties = [(1, "a b c d"), (2, "same"), (2, "same"), (2, "other"), (3, "z z z")]
    rows = merkle.compare_with_next(spark.createDataFrame(ties, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == 5 and len({r.edited_sha256 for r in rows}) >= 4


def test_branches_locate_edits():
    """A change of a word lies in the spans that two fingerprints tell, which are short; all else is equal text."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé漢", k=rng.randint(2, 8))) for _ in range(300)]
    for _ in range(200):
        own = rng.choices(words, k=400)
        place, sign = rng.randrange(400), rng.choice(" \n")
        new = own[:place] + ["CHANGED"] + own[place + 1 :]
        old_text, new_text = sign.join(own), sign.join(new)
        a, b = merkle.Tree.of(old_text.encode()).fingerprint, merkle.Tree.of(new_text.encode()).fingerprint
        spans = merkle.changes(a, b)
        at = new_text.index("CHANGED")
        assert any(s <= at < at + 7 <= e for s, e in spans) and sum(e - s for s, e in spans) < 400
        assert merkle.likeness(a, b) == merkle.likeness(b, a) and 0.6 < merkle.likeness(a, b) < 1
    assert merkle.changes(a, a) == [] and merkle.likeness(a, a) == 1
    empty = merkle.Tree.of(b"").fingerprint
    assert merkle.likeness(empty, a) == 0 and merkle.likeness(empty, empty) == 1 and merkle.changes(empty, b) == [(0, len(new_text))]


def test_order_matters():
    a, b = "# A\none\n# B\ntwo\n", "# B\ntwo\n# A\none\n"
    x, y = (merkle.Tree.of(t.encode()) for t in (a, b))
    assert x.root != y.root and x.likeness(y) < 1 and x.changes(y) == []
    assert merkle.Tree.of(b"a\nb").root != merkle.Tree.of(b"a b").root and merkle.Tree.of(b"").root != merkle.Tree.of(b"\n").root


def test_frames(spark, odd, none):
    assert merkle.fingerprints(odd).count() == odd.count() and merkle.fingerprints(none).count() == 0
    assert merkle.compare_with_next(odd).count() == odd.count() and merkle.compare_with_next(none).count() == 0
    old = spark.createDataFrame([(1, "a\nb\nc"), (2, "same"), (3, None)], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a\nX\nc"), (2, "same"), (3, "t")], "doc_id long, text string")
    assert {r.doc_id: [tuple(e) for e in r.edits] for r in merkle.locate_edits(old, new).collect()} == {1: [(2, 4)], 3: [(0, 1)]}


def test_runs_of_blank_lines_are_one_leaf():
    """Their tree doesn't grow with them, whatever white space they have, and time is linear."""
    one = merkle.Tree.of(b"one line\n\n \t\n\n# head\nand more")
    assert [sum(n for _, n in leaves) for _, leaves in one.sections] == [14, 15] or one.length == 29
    began = time.process_time()
    trees = [merkle.Tree.of(t) for t in (b"\n" * 1_000_000, b" \n\t" * 300_000, b"a\n" + b"\n" * 1_000_000 + b"b", b"\r\n" * 500_000)]
    assert time.process_time() - began < 10
    assert all(len(t.fingerprint) < 200 for t in trees) and [t.length for t in trees] == [1_000_000, 900_000, 1_000_003, 1_000_000]
    old, new = "x y\n" + "\n" * 50 + "z", "x y\n" + "\n" * 60 + "z"
    spans = merkle.changes(merkle.Tree.of(old.encode()).fingerprint, merkle.Tree.of(new.encode()).fingerprint)
    assert spans == [(4, 64)] and merkle.likeness(merkle.Tree.of(old.encode()).fingerprint, merkle.Tree.of(new.encode()).fingerprint) < 1
