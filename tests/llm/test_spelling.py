"""Spelling variants against edits of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tessella.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, s=spelling.Settings()):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % s.divisor == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                count[word] += 1
    n = {w: k for w, k in count.items() if k >= 5}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, []) if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w] and max(n[x] for x in near[w]) >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def result(df, **more):
    return sorted((tuple(r) for r in spelling.group_variants(df, **more).collect()), key=str)


def test_one_apart():
    rng, words, pairs = random.Random(1), [], []
    for _ in range(300):
        w = "".join(rng.choices("abcéÿ", k=rng.randint(6, 9)))
        i = rng.randrange(len(w))
        words += [w, rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :], w[1:] + w[0], w[::-1]])]
        pairs.append((len(words) - 2, len(words) - 1))
    pairs += [(i, j) for i, j in zip(range(0, 590), range(7, 597)) if abs(len(words[i]) - len(words[j])) <= 1]
    pairs = [(i, j) for i, j in pairs if abs(len(words[i]) - len(words[j])) <= 1]
    i, j = (np.array(x) for x in zip(*pairs))
    want = [one_edit(words[a], words[b]) for a, b in pairs]
    assert spelling.one_apart(words, i, j).tolist() == want and any(want) and not all(want)


def test_blocks_a_step_apart():
    """Words with one edit are in one block or just one visits the other's; distances tell them from most others."""
    rng = random.Random(2)
    for _ in range(400):
        w = "".join(rng.choices("abcdefghizé", k=rng.randint(6, 10)))
        i = rng.randrange(len(w))
        x = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abzé") + w[i + 1 :]])
        if x == w or len(x) < 1:
            continue
        counts = spelling.letter_counts([w, x])
        assert ((counts[0] - counts[1]) ** 2).sum() in (1, 2)
        rows, cells, home = spelling.visits(np.stack([counts[:, np.arange(spelling.LETTERS) % 5 == p].sum(1) for p in range(5)], 1))
        own = {r: {(c, h) for q, c, h in zip(rows.tolist(), cells.tolist(), home.tolist()) if q == r} for r in (0, 1)}
        meets = [(c, h, g) for c, h in own[0] for d, g in own[1] if c == d and (h or g)]
        assert len(meets) == 1


def made(seed, n_words=60):
    """Texts of words and their misspellings, in all forms of letters."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéØ", k=rng.randint(5, 9))) for _ in range(n_words)]
    def odd(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abe") + w[i:], w[:i] + rng.choice("abe") + w[i + 1 :], w.upper()])
    weights = [1 / (i + 1) for i in range(n_words)]
    return [(i, rng.choice([" ", "-", "1", "Ā", "\n"]).join(odd(w) for w in rng.choices(words, weights, k=60))) for i in range(150)]


def test_equals_all_pairs(spark):
    for block, parts in ((512, 5), (4, 1), (3, 8)):
        rows = made(block) + [(900, "eeeeee " * 5 + "eeeeea " * 30 + "eeeeaa " * 200)]
        df = spark.createDataFrame([(i, t, "w", 1, True) for i, t in rows], "doc_id long, text string, word string, n int, home boolean")
        s = spelling.Settings(block=block, parts=parts)
        got = result(df, settings=s)
        assert got == brute(rows, s) and any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)


def test_odd(spark):
    """Nulls, repeats, ties, long words, letters at the class's ends."""
    long = "ab" * 40_000
    rows = [(None, "letter lettar"), (1, None), (2, ""), (3, "letter " * 6), (3, "letter " * 6), (4, "lettar Letter LETTER " * 30), (5, " ".join([long + "x"] * 6 + [long] * 40)), (6, "Àÿbbbb× " * 5 + "¿bbbbbbĀ " * 5), (7, "tie-one tie-two ".replace("-", "") * 5), (8, "aaaaaa aaaaab aaaaac " * 7 + "aaaaad " * 40 + "aaaaae " * 40), (9, "short word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []


def test_query(spark, texts):
    assert sorted((tuple(r) for r in queries.op13_spelling(spark, SMALL).collect()), key=str) == brute(texts)
