"""Groups of spelling variants: words that one inserted, deleted or replaced code point makes equal.

A word's letters are counted; words with one difference have letter counts at squared distance 1 (insertion,
deletion) or 2 (replacement). Words are blocked by length and by their counts over `parts` groups of letters;
such words are in the same block or in blocks a step apart, so that a word lives in its block and visits the
blocks a step down (each pair meets once). Where words meet, a NumPy product of their letter-count matrices gives
all squared distances; pairs at 1 or 2 are then compared letter by letter, all of a block at once. A group
returns one row a word (near words and the most frequent of them), never pairs. Blocks of many words are
dealt over groups of two bounded blocks (see meet).

Defined cases: null and empty texts have no words; a null id counts as an empty text where it is hashed; equal rows
count each; of equally frequent near words the first in code-point order is taken; an empty table gives no
rows; a word may have any length; only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.meet import BLOCK, by_group, dealt, sizes, with_sizes
from tessella.llm.storage import bounded_batches, columns_of, discard, written
from tessella.llm.wordhash import U, mix

LETTERS = 26 + 0x40  # a-z and U+00C0 to U+00FF
#: Words that a task holds while it counts, and pairs of letters that are compared at once.
HELD, AT_ONCE = 200_000, 1 << 22


@dataclass(frozen=True)
class Settings:
    least_length: int = 6
    least_count: int = 5
    divisor: int = 199
    ratio: int = 5
    parts: int = 5
    block: int = BLOCK


def variants(words: Counter, prefix: bytes, s: Settings) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text's runs: some lose a letter by their hash with the text's id."""
    start = zlib.crc32(prefix)
    for word, n in words.items():
        h = zlib.crc32(word.encode(), start)
        if h % s.divisor == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < s.least_length:
                continue
        yield word, n


def counted(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(word, n) of all texts, of least_count occurrences or more."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % s.least_length)
    lower = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(runs.findall(text.lower() if text.isascii() else text.translate(lower))) if text else {}
                for word, n in variants(words, f"{'' if key is None else key}:".encode(), s):
                    held[word] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    words = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all words' letters as numbers from 0, lengths)."""
    codes = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int64)
    return np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26), np.array([len(w) for w in words], np.int64)


def letter_counts(words: list[str]) -> np.ndarray:
    codes, n = letters(words)
    rows = np.repeat(np.arange(len(words)), n)
    return np.bincount(rows * LETTERS + codes, minlength=len(words) * LETTERS).reshape(-1, LETTERS)


def visits(counts: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cells, whether it is the row's home) for counts over groups of letters.

    Down are the cells with one letter less in some group, and those where a letter moves to a later group: of
    two cells a step apart just one is down from the other.
    """
    k = counts.shape[1]
    odd = np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)
    own = (counts.astype(np.uint64) * odd).sum(1, dtype=np.uint64)
    steps = [(i, U(0)) for i in range(k)] + [(i, odd[j]) for i in range(k) for j in range(i + 1, k)]
    rows, cells = [np.arange(len(counts))], [own]
    for i, more in steps:
        some = np.flatnonzero(counts[:, i] > 0)
        rows.append(some)
        cells.append(own[some] - odd[i] + more)
    home = np.arange(sum(map(len, rows))) < len(counts)
    return np.concatenate(rows), mix(np.concatenate(cells)).view(np.int64), home


def _padded(words: list[str], width: int) -> np.ndarray:
    codes, n = letters(words)
    out = np.full((len(words), width), -1, np.int16)
    rows = np.repeat(np.arange(len(words)), n)
    out[rows, np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)] = codes
    return out


def one_apart(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words[i] and words[j] differ by exactly one inserted, deleted or replaced letter. Lengths differ by one at most."""
    n = np.array([len(w) for w in words], np.int64)
    short, long = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    out = np.zeros(len(i), bool)
    for length in np.unique(n[short]).tolist():
        some = np.flatnonzero(n[short] == length)
        for at in range(0, len(some), step := max(1, AT_ONCE // (length + 1))):
            part = some[at : at + step]
            used, place = np.unique(np.concatenate([short[part], long[part]]), return_inverse=True)
            codes = _padded([words[w] for w in used.tolist()], length + 1)
            a, b = codes[place[: len(part)]], codes[place[len(part) :]]
            same = a[:, :length] == b[:, :length]
            shifted = a[:, :length] == b[:, 1:]
            replaced = (~same).sum(1) == 1
            before = np.where(same.all(1), length, (~same).argmax(1))
            after = np.where(shifted.all(1), length, (~shifted[:, ::-1]).argmax(1))
            out[part] = np.where(n[short[part]] == n[long[part]], replaced, before + after >= length)
    return out


def _near(batch: pa.RecordBatch, inside: bool) -> pa.RecordBatch | None:
    """Per word of a group with near ones there: how many, and the most frequent of them."""
    words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
    left = batch.column("left").to_numpy(zero_copy_only=False)
    counts = letter_counts(words)
    # Whole numbers are exact in 32 bits up to 2^24.
    c = counts.astype(np.float32 if counts.max(initial=0) < 1 << 9 else np.float64)
    squares, a, b = (c * c).sum(1), np.flatnonzero(left), np.flatnonzero(~left)
    pairs = []
    for x, y, same in ((a, a, True), (a, b, False)) if inside else ((a, b, False),):
        apart = squares[x][:, None] + squares[y] - 2 * (c[x] @ c[y].T)
        i, j = np.nonzero((apart > 0) & (apart <= 2) & (np.triu(np.ones(apart.shape, bool), 1) if same else True))
        pairs.append((x[i], y[j]))
    i, j = (np.concatenate(p) for p in zip(*pairs))
    yes = one_apart(words, i, j)
    i, j = np.concatenate([i[yes], j[yes]]), np.concatenate([j[yes], i[yes]])
    if not len(i):
        return None
    alphabetical = np.empty(len(words), np.int64)
    alphabetical[np.argsort(np.array(words, object))] = np.arange(len(words))
    order = np.lexsort((alphabetical[j], -n[j], i))
    i, j = i[order], j[order]
    who, first, near = np.unique(i, return_index=True, return_counts=True)
    best = j[first]
    return pa.record_batch([pa.array([words[w] for w in who.tolist()]), pa.array(near), pa.array(n[best]), pa.array([words[w] for w in best.tolist()])], ["word", "near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last by doubling. Forms lead to ever more frequent words, so that none returns."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = columns_of(step, "word", "root")
        if not step.where("moved").limit(1).count():
            return at


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per word: word, form (null if none), root, n, n_near and form_n."""
    s = settings
    bounded_batches(docs.sparkSession)
    words = written(counted(docs, id_col, text_col, s), "words")
    group_of = np.arange(LETTERS) % s.parts

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = letter_counts(batch.column("word").to_pylist())
            by_part = np.stack([counts[:, group_of == p].sum(1) for p in range(s.parts)], 1)
            rows, cells, home = visits(by_part)
            own = batch.take(pa.array(rows))
            yield pa.record_batch([own.column("word"), own.column("n"), pa.array(cells), pa.array(home)], ["word", "m", "cell", "home"])

    met = written(words.mapInArrow(blocked, "word string, m long, cell long, home boolean"), "visits")
    found = sizes(met, F.col("home")).where("homes > 0 and n > 1")
    members = dealt(with_sizes(met.withColumn("spread", F.xxhash64("word")), found), s.block).withColumnRenamed("m", "n")
    near = members.mapInArrow(by_group(_near), "word string, near long, best_n long, best string")
    # The largest n, of equal ones the first word: the least of (-n, word).
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("best"))
    frequent = -F.col("best.n") >= s.ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", F.when(frequent, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, -F.col("best.n")).alias("form_n"))
    out = written(out, "word-forms")
    discard(words, met)
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
