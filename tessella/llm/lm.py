"""A Katz backoff trigram model: Good-Turing discounted counts, exactly normalised backoff weights.

Text. A-Z is lower-cased; words are runs of characters other than white space; each document ends
with an end token, which also stands for the two tokens before its first word.

Probability of a token w after u, v, recursively (P2 after v, P1 without a context):
    P3(w | u, v) = d3(c) c / T(u, v)            for c = c(u, v, w) > 0 in training
                 = alpha(u, v) P2(w | v)         otherwise; P2(w | v) itself where u, v was no context
    P2 likewise from the counts of pairs, with P1 below it
    P1(w) = d1(c) c / T for words of training and the end; what that leaves is one class of all other words
d are Katz's discounts with Good-Turing counts of counts for c up to 5, of each order, and 1 above;
T is the context's count (one token more if no count of it is discounted), alpha makes the sum over all
words and the unknown class 1.

Tables. Documents are packed into blocks (some hundred thousand tokens), written once, bucketed by block, so
that joins move the answers only. Each block sends its distinct words, then pairs, then trigrams with training
counts to hash partitions, which add them up and answer (see exchange). An answer tells the total, whether
several blocks have the n-gram, and names one block as its owner. If a context was seen once and only one
block has it, its single continuation is known there, and nothing is sent for it. The sums over a context's
continuations, by which a partition computes the stored weights T and alpha of its contexts, are sent by the
owners of the continuations and exchanged in the same way. So all tables grow with the corpus and stay
partitioned; only some numbers for each order (counts of counts) are sent to all tasks.

Defined cases: a null or empty text is its end token alone; ids may be null or repeated, a null id is
in training; without training documents all words are unknown; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import BLOCK_ROWS, Question, Shape, Totals, answered, ask, distinct, from_gaps, from_small, gaps, gathered, in_order, packed, packed_ids, small, summed, token_blocks, unpacked, unpacked_ids
from tessella.llm.storage import bounded_batches, bucketed, discard, small_batches, written
from tessella.llm.wordhash import U, mix

END = 0  # its place among a block's words, and its hash
KATZ = 5
BASE_PRIOR = 0.1


@dataclass(frozen=True)
class Settings:
    held_out_of: int = 10


BLOCK = "block long, ids binary, training binary, ends binary, tokens binary, words binary, counts binary"


def blocks(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """A row per block: ids and lengths of its documents, tokens (places in words) and the words' hashes and training counts."""
    held = _held_out(id_col, settings)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (~held).alias("training"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts, words, ends in token_blocks(batches, "nonspace", lambda b: [(t or b"").lower() for t in b.column(1).cast(pa.binary()).to_pylist()]):
            training = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
            different, tokens = np.unique(words, return_inverse=True)
            learned = np.bincount(tokens[np.repeat(training, ends)], minlength=len(different))
            ids = packed_ids(pa.concat_arrays([p.column(0) for p in parts]))
            data = {"block": number, "ids": ids, "training": packed(training), "ends": small(ends), "tokens": small(tokens), "words": gaps(different), "counts": small(learned)}
            yield pa.record_batch([pa.array([v]) for v in data.values()], list(data))

    return rows.mapInArrow(pack, BLOCK)


def _held_out(id_col: str, settings: Settings) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % settings.held_out_of == 0, F.lit(False))


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..KATZ) from n[r], the number of n-grams seen r times (r up to KATZ + 1).

    Where Good-Turing gives no ratio in (0, 1), absolute discounting by a half is used.
    """
    d = np.ones(KATZ + 1)
    n = n.astype(float)
    tail = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        value = (ratio - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * d[np.where(counts > KATZ, 0, counts)]


@dataclass(frozen=True)
class Unigrams:
    """What is known of all words together."""

    tokens: int
    ends: int
    different: int  # with the end
    d: np.ndarray
    total: int
    unknown: float  # the probability of all words that aren't in training

    @classmethod
    def of(cls, sums: np.ndarray, ends: int) -> Unigrams:
        """sums: words by count (0 to KATZ + 1), different words, tokens."""
        n, (different, tokens) = sums[: KATZ + 2].copy(), sums[KATZ + 2 : KATZ + 4]
        if 0 < ends <= KATZ + 1:
            n[ends] += 1
        d = discounts(n)
        r = np.arange(KATZ + 1)
        left = (n[: KATZ + 1] * r * (1 - d)).sum()
        every = int(tokens) + ends
        total = every + (left <= 0)
        return cls(every, ends, int(different) + (ends > 0), d, int(total), float((total - every + left) / total))  # without training 1

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, kept(counts, self.d) / self.total, self.unknown)


@dataclass
class Grams:
    """A block's n-grams of one order.

    keys: hashes. context, low: places of an n-gram's context and of the n-gram without its first word among
    the order below (for contexts that stand at a document's begin: the last place). local: training counts.
    Then, as they become known, counts (totals), own (this block is the owner) and shared (other blocks may have it).
    """

    keys: np.ndarray
    context: np.ndarray
    low: np.ndarray
    local: np.ndarray
    counts: np.ndarray | None = None
    own: np.ndarray | None = None
    shared: np.ndarray | None = None


@dataclass
class Contexts:
    """What may be a context of an order: keys, counts C, and whether other blocks may have it."""

    keys: np.ndarray
    counts: np.ndarray
    shared: np.ndarray
    total: np.ndarray | None = None  # T
    alpha: np.ndarray | None = None


def ascending(keys: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of which (a mask), by their keys."""
    at = np.flatnonzero(which)
    return at[np.argsort(keys[at])]


def hashed(context: np.ndarray, word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The key of an n-gram; its last bit tells whether it ends with the end token, so that it is no context."""
    with np.errstate(over="ignore"):
        h = mix(mix(context + U(0x9E3779B97F4A7C15)) + word * U(0xD6E8FEB86659FD93))
    return h & ~U(1) | end.astype(U)


class Block:
    """A block's tokens, pairs and trigrams, with what the answers so far tell of them."""

    def __init__(self, row: dict, unigrams: Unigrams, n: int):
        hashes, self.ends, self.training = from_gaps(row["words"]), from_small(row["ends"]), unpacked(row["training"], bool)
        self.number, self.ids, self.parts = row["block"], row.get("ids"), n
        answer = in_order(row["words_known"], hashes, n)
        words = np.concatenate([[U(END)], hashes])
        self.words = Contexts(words, np.concatenate([[unigrams.ends], answer >> 2]), np.concatenate([[True], answer & 1 > 0]))
        tokens = np.insert((from_small(row["tokens"]) + 1).astype(np.int32), np.cumsum(self.ends), END)
        learned = np.repeat(self.training, self.ends + 1)
        self.first = np.concatenate([[0], np.cumsum(self.ends + 1)[:-1]]) if len(self.ends) else np.zeros(0, np.int64)
        before = np.concatenate([np.array([END], np.int32), tokens[:-1]]) if len(tokens) else tokens
        self.tokens = tokens
        pair, self.pair_of, self.pairs = self._distinct(before, tokens, learned, words, words, tokens)
        # A trigram's context is the pair before; at a document's begin the place after all pairs.
        context = np.concatenate([np.array([len(pair)], np.int32), self.pair_of[:-1]]) if len(tokens) else tokens
        context[self.first] = len(pair)
        _, self.trigram_of, self.trigrams = self._distinct(context, tokens, learned, words, np.append(self.pairs.keys, U(END)), self.pair_of)

        if "pairs_known" in row:
            self._learn(self.pairs, self.words, row["pairs_known"])
            self.before = Contexts(np.append(self.pairs.keys, U(END)), np.append(self.pairs.counts, unigrams.ends), np.append(self.pairs.shared, True))

    @staticmethod
    def _distinct(context: np.ndarray, word: np.ndarray, learned: np.ndarray, words: np.ndarray, context_keys: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, Grams]:
        """(the distinct n-grams' numbers, each token's n-gram, the n-grams); word: places among words."""
        gram, one, place = distinct(context.astype(np.int64) * len(words) + word)
        return gram, place, Grams(hashed(context_keys[context[one]], words[word[one]], word[one] == END), context[one], low[one], np.bincount(place[learned], minlength=len(gram)))

    @staticmethod
    def _asked(grams: Grams, contexts: Contexts) -> np.ndarray:
        """The places of the n-grams that are asked for, by their keys: those whose context others may have, too."""
        return ascending(grams.keys, contexts.shared[grams.context] & (contexts.counts[grams.context] > 0))

    def question(self, grams: Grams, contexts: Contexts) -> Question:
        at = self._asked(grams, contexts)
        return grams.keys[at], grams.local[at]

    def singles(self, grams: Grams, contexts: Contexts) -> Question:
        """Under the block's number: how many n-grams were seen that aren't asked for."""
        asked = contexts.shared[grams.context] & (contexts.counts[grams.context] > 0)
        return np.array([self.number], U), np.array([(grams.local[~asked] > 0).sum()])

    def _learn(self, grams: Grams, contexts: Contexts, answers: list[dict] | None) -> None:
        """Takes in the answers to question(); all that wasn't asked for is in this block alone."""
        at = self._asked(grams, contexts)
        answer = in_order(answers, grams.keys[at], self.parts)
        grams.counts, grams.own, grams.shared = grams.local.copy(), np.ones(len(grams.keys), bool), np.zeros(len(grams.keys), bool)
        grams.counts[at], grams.own[at], grams.shared[at] = answer >> 2, answer & 2 > 0, answer & 1 > 0

    def learn_trigrams(self, answers: list[dict]) -> None:
        self._learn(self.trigrams, self.before, answers)

    def sums(self, grams: Grams, contexts: Contexts, low: np.ndarray) -> np.ndarray:
        """Rows of sums by context over the block's own n-grams, low being the counts of the order below.

        Rows: seen ones by count (1 to KATZ), tokens of larger counts, the same of their low counts; last the
        number of n-grams that aren't seen in training, for which the block needs alpha.
        """
        seen = grams.own & (grams.counts > 0)
        place, n = grams.context[seen], len(contexts.keys)
        add = lambda x: np.bincount(place, x, n).astype(np.int64)
        rows = []
        for counts in (grams.counts[seen], low[grams.low[seen]]):
            rows += [*(add(counts == r) for r in range(1, KATZ + 1)), add(np.where(counts > KATZ, counts, 0))]
        return np.stack([*rows, np.bincount(grams.context[grams.counts == 0], minlength=n)])

    def context_question(self, grams: Grams, contexts: Contexts, low: np.ndarray) -> Question:
        at = self._asked_contexts(grams, contexts)
        return contexts.keys[at], self.sums(grams, contexts, low)[:, at]

    @staticmethod
    def _asked_contexts(grams: Grams, contexts: Contexts) -> np.ndarray:
        used = np.zeros(len(contexts.keys), bool)
        used[grams.context] = True
        return ascending(contexts.keys, used & contexts.shared & (contexts.counts > 0))

    def weigh(self, grams: Grams, contexts: Contexts, low: np.ndarray, low_total: np.ndarray | int, d: np.ndarray, low_d: np.ndarray, answers: list[dict], question: int) -> None:
        """Sets T and alpha of the contexts, from the answers to context_question() and from the block's own n-grams."""
        more, kept_, below = masses(self.sums(grams, contexts, low), d, low_d)
        at = self._asked_contexts(grams, contexts)
        known = in_order(answers, contexts.keys[at], self.parts, question, lambda b: unpacked(b, np.float64).reshape(3, -1))
        if len(at):
            more[at], kept_[at], below[at] = known
        contexts.total = contexts.counts + more
        with np.errstate(divide="ignore", invalid="ignore"):  # of what was never a context
            alpha = (1 - kept_ / contexts.total) / (1 - below / low_total)
        contexts.alpha = np.where(contexts.counts > 0, alpha, 1.0)


def masses(sums: np.ndarray, d: np.ndarray, low_d: np.ndarray) -> np.ndarray:
    """From rows of contexts' sums: whether T is one token more, the discounted counts, those of the order below."""
    r = np.arange(1, KATZ + 1)
    of = lambda rows, d: (d[1:] * r) @ rows[:KATZ] + rows[KATZ]
    tokens, kept_ = of(sums, np.ones(KATZ + 1)), of(sums, d)
    return np.stack([((kept_ >= tokens) & (tokens > 0)).astype(float), kept_, of(sums[KATZ + 1 :], low_d)])


def probability(grams: Grams, contexts: Contexts, d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Of each n-gram's last word after its context; below: of the order below."""
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = kept(grams.counts, d) / contexts.total[grams.context]
    return np.where(grams.counts > 0, seen, contexts.alpha[grams.context] * below[grams.low])


def told(found: Totals) -> list[bytes]:
    """Answers: the total times 4, and 2 for the owner, and 1 where it was seen twice or several blocks asked."""
    every = found.counts[0] * 4 + ((found.askers() > 1) | (found.counts[0] > 1))
    return [small(every[p] + 2 * own) for p, own in zip(found.places, found.first_asks())]


def nothing(found: Totals) -> list[bytes]:
    return [b""] * len(found.blocks)


SUMS = KATZ + 4


def sums_of(found: Totals) -> bytes:
    """Keys by count (0 to KATZ + 1), different ones, tokens."""
    n = found.counts[0]
    return packed(np.array([0, *((n == r).sum() for r in range(1, KATZ + 2)), (n > 0).sum(), n.sum()], np.int64))


def singles(found: Totals) -> bytes:
    """The same of n-grams that blocks haven't asked for, of which they tell the number that was seen: once each."""
    n = found.counts[0].sum()
    return packed(np.array([0, n, *[0] * KATZ, n, n], np.int64))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    found = bucketed(blocks(docs, id_col, text_col, settings), "lm-blocks", "block", buckets)
    ends = docs.where(~_held_out(id_col, settings)).count()
    with small_batches(spark, BLOCK_ROWS):
        out = _scored(found, buckets, ends)
    return out.withColumnRenamed("id", id_col)


def _scored(found: DataFrame, buckets: int, ends: int) -> DataFrame:
    shape, share = Shape.of(found), found.sparkSession.sparkContext.broadcast
    n = shape.parts

    def exchanged(rows: DataFrame, question, label: str, **how) -> tuple[DataFrame, np.ndarray]:
        """(the answers by block, the sums of the parts' summaries)."""
        answers = answered(ask(rows, question, n), shape, f"lm-{label}", **how)
        sums = summed(answers, SUMS)  # none without a summary
        by_block = bucketed(gathered(answers, buckets).withColumnRenamed("answers", label), f"lm-{label}", "block", buckets)
        discard(answers)
        return by_block, sums

    def joined(*tables: DataFrame) -> DataFrame:
        rows = found.drop("counts")
        for t in tables:
            rows = rows.join(t.hint("merge"), "block", "left")
        return rows

    words, sums = exchanged(found.select("block", "words", "counts"), lambda row: [(from_gaps(row["words"]), from_small(row["counts"]))], "words_known", summary=sums_of, reply=told)
    unigrams = share(Unigrams.of(sums, ends))

    def ask_pairs(row: dict) -> list[Question]:
        block = Block(row, unigrams.value, n)
        return [block.question(block.pairs, block.words), block.singles(block.pairs, block.words)]

    pairs, sums = exchanged(joined(words).drop("ids"), ask_pairs, "pairs_known", summary=lambda t: sums_of(t) if t.question == 0 else singles(t), reply=lambda t: told(t) if t.question == 0 else nothing(t))
    d2 = share(discounts(sums[: KATZ + 2]))

    def ask_trigrams(row: dict) -> list[Question]:
        block = Block(row, unigrams.value, n)
        return [block.question(block.trigrams, block.before), block.context_question(block.pairs, block.words, block.words.counts), block.singles(block.trigrams, block.before)]

    def weights(d, low_d):
        def reply(totals: Totals) -> list[bytes]:
            more, kept_, below = masses(totals.counts, d.value, low_d())
            need = totals.last
            return [packed(np.stack([more[p], np.where(yes, kept_[p], 0.0), np.where(yes, below[p], 0.0)])) for p, yes in zip(totals.places, need)]

        return reply

    after_word = weights(d2, lambda: unigrams.value.d)
    trigrams, sums = exchanged(
        joined(words, pairs).drop("ids"),
        ask_trigrams,
        "trigrams_known",
        summary=lambda t: (sums_of, lambda t: packed(np.zeros(SUMS, np.int64)), singles)[t.question](t),
        reply=lambda t: (told, after_word, nothing)[t.question](t),
    )
    d3 = share(discounts(sums[: KATZ + 2]))

    def ask_contexts(row: dict) -> list[Question]:
        block = Block(row, unigrams.value, n)
        block.learn_trigrams(row["trigrams_known"])
        return [block.context_question(block.trigrams, block.before, block.pairs.counts)]

    contexts, _ = exchanged(joined(words, pairs, trigrams).drop("ids"), ask_contexts, "contexts_known", reply=weights(d3, lambda: d2.value))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _scores(row, unigrams.value, d2.value, d3.value, n)

    rows = joined(words, pairs, trigrams, contexts)
    out = written(rows.mapInArrow(evaluate, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    discard(found, words, pairs, trigrams, contexts)
    return out


def weighed(row: dict, unigrams: Unigrams, d2: np.ndarray, d3: np.ndarray, n: int) -> Block:
    """A block with all it needs to know."""
    block = Block(row, unigrams, n)
    block.learn_trigrams(row["trigrams_known"])
    words, before = block.words, block.before
    block.weigh(block.pairs, words, words.counts, unigrams.total, d2, unigrams.d, row["trigrams_known"], 1)
    last = np.append(block.pairs.low, END)  # the last word of a pair that is a context
    with np.errstate(invalid="ignore"):
        block.weigh(block.trigrams, before, block.pairs.counts, words.total[last], d3, d2, row["contexts_known"], 0)
    return block


def _scores(row: dict, unigrams: Unigrams, d2: np.ndarray, d3: np.ndarray, n: int) -> pa.RecordBatch:
    block = weighed(row, unigrams, d2, d3, n)
    counts = block.words.counts
    base = np.log10((counts + BASE_PRIOR) / (unigrams.tokens + BASE_PRIOR * (unigrams.different + 1)))
    p = probability(block.pairs, block.words, d2, unigrams.p(counts))
    p = np.log10(probability(block.trigrams, block.before, d3, p))
    add = lambda x, t: np.add.reduceat(x.astype(t), block.first)
    size = len(block.ends)
    return pa.record_batch(
        [unpacked_ids(block.ids), pa.array(~block.training), pa.array(block.ends + 1), pa.array(add(counts[block.tokens] > 0, np.int64)), pa.array(np.full(size, unigrams.tokens)), pa.array(add(base[block.tokens], float)), pa.array(add(p[block.trigram_of], float))],
        ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
