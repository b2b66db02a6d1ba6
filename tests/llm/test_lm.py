"""Katz backoff: base columns and whole probabilities against a plain rendering; sums to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import exchange, lm, queries

SMALL = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*TOKEN.findall((text or "").translate(LOWER)), None]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def plain_discounts(counts):
    """Katz's discounts from Good-Turing counts; absolute discounting by a half where they give none in (0, 1)."""
    n = Counter(c for c in counts if c)
    out = {}
    for r in range(1, 6):
        out[r] = (r - 0.5) / r
        if n[1] and n[r] and 6 * n[6] / n[1] < 1:
            tail = 6 * n[6] / n[1]
            value = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
            out[r] = value if 0 < value < 1 else out[r]
    return out


class Plain:
    """The model with dictionaries: an n-gram is a tuple, None the end, OTHER any unknown word."""

    OTHER = object()

    def __init__(self, docs):
        self.n = [Counter(), Counter(), Counter()]
        for i, t in docs:
            if not is_held(i):
                d = [None, None, *tokens(t)]
                for j in range(2, len(d)):
                    for order in range(3):
                        self.n[order][tuple(d[j - order : j + 1])] += 1
        self.c = Counter({w: c for (w,), c in self.n[0].items()})
        self.tokens, self.v = sum(self.c.values()), len(self.c)
        self.d = [plain_discounts(n.values()) for n in self.n]
        self.after = defaultdict(dict)
        for counts in self.n:
            for gram, c in counts.items():
                self.after[gram[:-1]][gram[-1]] = c
        self.left = {}

    def p(self, context, w):
        """P(w | context)."""
        order, after = len(context), self.after.get(context)
        if order and not after:
            return self.p(context[1:], w)
        if not after:
            return float(w is self.OTHER)
        if context not in self.left:
            total = sum(after.values())
            kept = sum(self.d[order].get(c, 1) * c for c in after.values())
            total += kept >= total
            seen = sum(self.p(context[1:], x) for x in after) if order else 0
            self.left[context] = total, (1 - kept / total) / (1 - seen)
        total, alpha = self.left[context]
        if w in after:
            return self.d[order].get(after[w], 1) * after[w] / total
        return alpha * (self.p(context[1:], w) if order else float(w is self.OTHER))

    def score(self, text):
        d = [None, None, *((w if w in self.c else self.OTHER) for w in tokens(text))]
        d[-1] = None
        return sum(math.log10(self.p((d[j - 2], d[j - 1]), d[j])) for j in range(2, len(d)))


def check(rows, docs):
    plain = Plain(docs)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, t in docs:
        w, r = tokens(t), got[i]
        base = sum(math.log10((plain.c[x] + 0.1) / (plain.tokens + 0.1 * (plain.v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(i), len(w), sum(plain.c[x] > 0 for x in w), plain.tokens)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - plain.score(t)) < 1e-6 * max(1, abs(r.score))
    return plain


def test_query_and_held_out_gain(spark, texts):
    rows = queries.op9_katz(spark, SMALL).collect()
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("seed, slice_blocks", [(12, 4096), (13, 4096), (12, 1), (13, 3)])
def test_equals_plain_and_sums_to_one(spark, seed, slice_blocks, monkeypatch):
    monkeypatch.setattr(exchange, "SLICE_BLOCKS", slice_blocks)
    rng = random.Random(seed)
    words = ["a", "B", "é", "the,", "x1", "y", "z", "#", "Q"]
    docs = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choices(words, [2**-k for k in range(9)], k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "unknown words here only"), (230, "\xa0 nbsp\x1cone"), (301, "once seen a b"), (302, "once more once seen a b")]
    docs += [(i, "zig zag zig zag zog") for i in range(400, 420) if is_held(i)] + [(500, "zig zag zig")]  # seen once, asked by others
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(17 if seed == 13 else 3)
    plain = check(lm.score(frame).collect(), docs)
    every = [*plain.c, plain.OTHER]
    contexts = [(), *plain.n[0], *plain.n[1], ("a", "nothing"), (None, None), ("nothing", "a")]
    for context in contexts:
        assert abs(sum(plain.p(context, w) for w in every) - 1) < 1e-9


def test_counts_of_rare_words(spark):
    """In a corpus where a hundred-thousandth of the tokens is more than one, n-grams of words seen once count."""
    rng = random.Random(14)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=2200)) + f" zig{i} zag{i} zig{i}") for i in range(120)]
    held = next(i for i in range(200, 300) if is_held(i))
    docs += [(held, "zig1 zag1 zig1 other")]
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    plain = check(rows, docs)
    assert plain.tokens > 200_000 and ("zig1", "zag1", "zig1") in plain.n[2]


def test_packing():
    rng = np.random.default_rng(13)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (exchange.from_gaps(exchange.gaps(keys)) == keys).all() and len(exchange.from_gaps(exchange.gaps(keys[:0]))) == 0
    n = rng.integers(0, 1 << 31, 1000)
    assert (exchange.from_small(exchange.small(n)) == n).all()


def test_odd(spark, odd, none):
    rows = lm.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score(none).count() == 0
    held = spark.createDataFrame([(i, "a b c") for i in range(200) if is_held(i)], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in lm.score(held).collect())
