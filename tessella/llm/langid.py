"""Language ID with spans: script ranges, per-word scores and a Viterbi pass with a switching penalty.

A word is a run of letters (a-z and non-ASCII bytes). Its score under a language is the sum of the
log probabilities of its hashed byte 4-grams, the word's bounds included, scaled by SHARPNESS as the
grams overlap. The script of its characters leaves only languages that were seen with that script.
The best sequence of languages, less PENALTY for each change, labels the words; neighbours of one
language form a span. A document's language is the one with most letters in its spans, its score the
share of all letters there.

The model is fitted on a sample of labelled rows with an expected size of per_language rows for each
language (all rows of smaller ones), drawn by a hash of id and text.

Defined cases: a text that is null or has no letter is `und` with score 0 and no spans; letters whose
script no language was seen with belong to no span, and a text of only such letters gets the
language with most training text and score 0; without labelled rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import bounded_batches, trimmed

GRAM_BITS = 16
SHARPNESS, PENALTY, PRIOR = 0.5, 8.0, 0.3
FORBIDDEN = -1e4
GROUP_BYTES = 1 << 19
#: First code points of script blocks (fixed values) and the scripts' numbers: 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Indic, 8 Thai and Lao, 9 other, 10 Kana, 11 Han, 12 Hangul; 0 none.
SCRIPT_STARTS = np.array([0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xB5, 0xB6, 0xBA, 0xBB, 0xC0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0xF00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3041, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0x10000, 0x1B000, 0x1F000, 0x20000, 0x40000])
SCRIPT_OF = np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 9, 1, 2, 0, 10, 11, 12, 10, 11, 9, 12, 0, 11, 1, 5, 6, 0, 6, 1, 9, 10, 0, 11, 0])
SCRIPTS = 13


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # by amount of training text, most first
    grams: np.ndarray  # [gram, language] log probabilities
    scripts: np.ndarray  # [script, language] whether seen


@dataclass
class Words:
    """Words of joined texts: byte bounds, the text of each, its grams' numbers and bounds, its script."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    script: np.ndarray


def words(texts: list[bytes]) -> Words:
    lower = b"\n".join(texts).lower()
    b = np.frombuffer(lower, np.uint8).copy()
    if len(b) > 1:  # capital letters of Latin-1
        high = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][high] += 0x20
    inside = ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(begins, start, "right") - 1
    size = end - start + 1  # a gram ends at each byte and at the bound behind the word
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    at = np.repeat(start, size) + place
    padded = np.append(np.where(inside, b, 0x20), 0x20).astype(np.uint32)
    code = padded[at]
    for k in (1, 2, 3):
        back = np.where(place >= k, padded[np.maximum(at - k, 0)], np.where(place == k - 1, 0x20, 0))
        code = code * np.uint32(0x01000193) ^ back.astype(np.uint32)
    grams = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
    script = np.zeros(len(start), np.int8)
    if len(start):
        script = np.maximum.reduceat(_scripts(b), start).astype(np.int8)
    return Words(text, start - begins[text], end - begins[text], grams, first, script)


def _scripts(b: np.ndarray) -> np.ndarray:
    """By byte: the script of the character that begins there, 0 elsewhere."""
    out = np.zeros(len(b), np.int8)
    out[(b >= 0x61) & (b <= 0x7A)] = 1
    lead = np.flatnonzero(b >= 0xC2)
    if len(lead):
        wide = np.concatenate([b, np.zeros(3, np.uint8)]).astype(np.int32)
        x, y, z, w = (wide[lead + i] for i in range(4))
        two, three = (x & 0x1F) << 6 | y & 0x3F, (x & 0xF) << 12 | (y & 0x3F) << 6 | z & 0x3F
        four = (x & 7) << 18 | (y & 0x3F) << 12 | (z & 0x3F) << 6 | w & 0x3F
        code = np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))
        out[lead] = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, code, "right") - 1]
    return out


def word_scores(model: Model, own: Words) -> np.ndarray:
    """[word, language]; words without a candidate have zeros."""
    scores = np.add.reduceat(model.grams[own.grams], own.first, axis=0) * np.float32(SHARPNESS)
    allowed = model.scripts[own.script]
    scores = np.where(allowed, scores, np.float32(FORBIDDEN))
    scores[~allowed.any(axis=1)] = 0
    return scores


def viterbi(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best language of each word; counts: words by text. All texts advance together."""
    n, languages = scores.shape
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    active = np.searchsorted(-counts[order], -np.arange(1, counts.max(initial=0) + 1), "right")  # texts with so many words
    came = np.zeros((n, languages), np.int16)
    best = scores[first[order]].copy()
    stay = np.arange(languages, dtype=np.int16)
    for t in range(1, len(active)):
        rows = first[order[: active[t]]] + t
        prior = best[: active[t]]
        top = prior.argmax(axis=1)
        change = prior[np.arange(len(rows)), top] - np.float32(PENALTY)
        switch = change[:, None] > prior
        came[rows] = np.where(switch, top[:, None], stay)
        best[: active[t]] = np.where(switch, change[:, None], prior) + scores[rows]
    out = np.zeros(n, np.int16)
    state = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        rows = first[order[: active[t]]] + t
        now = state[: active[t]]
        out[rows] = now
        state[: active[t]] = came[rows, now]
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


Label = tuple[str, float, list[tuple[str, int, int]]]


def label(model: Model, texts: list[str | None]) -> list[Label]:
    """(language, score, spans) of each text; spans are in code points."""
    out: list[Label] = [("und", 0.0, [])] * len(texts)
    full = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
    at = 0
    while at < len(full):
        data, size = [], 0
        for i in full[at:]:
            if data and size > GROUP_BYTES:
                break
            data.append(texts[i].encode())
            size += len(data[-1])
        own = words(data)
        counts = np.bincount(own.text, minlength=len(data))
        best = viterbi(word_scores(model, own), counts)
        known = model.scripts[own.script].any(axis=1)
        last = 0
        for j, i in enumerate(full[at : at + len(data)]):
            rows = slice(last, last + counts[j])
            last += counts[j]
            out[i] = _summary(model, data[j], own.start[rows], own.end[rows], best[rows], known[rows])
        at += len(data)
    return out


def _summary(model: Model, data: bytes, start: np.ndarray, end: np.ndarray, best: np.ndarray, known: np.ndarray) -> Label:
    size = end - start
    weight = np.bincount(best[known], size[known], len(model.languages))
    top = int(weight.argmax())
    start, end, best = start[known], end[known], best[known]
    if not len(best):
        return model.languages[0], 0.0, []
    new = np.flatnonzero(np.diff(best, prepend=-1))
    begin, stop = start[new], end[np.append(new[1:] - 1, len(best) - 1)]
    if not data.isascii():
        places = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        begin, stop = places[begin], places[stop]
    return model.languages[top], float(weight[top] / size.sum()), [(model.languages[k], int(a), int(b)) for k, a, b in zip(best[new], begin, stop)]


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 4000) -> Model:
    """From rows with a language and a text."""
    bounded_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model((), np.zeros((1 << GRAM_BITS, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))))
    sample = rows.where(F.xxhash64("id", "text").bitwiseAND((1 << 30) - 1) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lang in set(langs):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                total = found.setdefault(lang, np.zeros((1 << GRAM_BITS) + SCRIPTS, np.int64))
                while mine:
                    n, size = 0, 0
                    while n < len(mine) and (n == 0 or size <= GROUP_BYTES):
                        size += len(mine[n])
                        n += 1
                    own = words(mine[:n])
                    total[: 1 << GRAM_BITS] += np.bincount(own.grams, minlength=1 << GRAM_BITS)
                    total[1 << GRAM_BITS :] += np.bincount(own.script, own.end - own.start, SCRIPTS).astype(np.int64)
                    mine = mine[n:]
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(total[at])], ["lang", "i", "n"])

    counts = sample.mapInArrow(count, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    table = np.zeros(((1 << GRAM_BITS) + SCRIPTS, len(langs)))
    table[counts["i"].to_numpy(np.int64), np.searchsorted(langs, counts["lang"].to_numpy(str))] = counts["n"]
    grams, scripts = table[: 1 << GRAM_BITS], table[1 << GRAM_BITS :].copy()
    scripts[0] = 0
    order = np.argsort(-grams.sum(axis=0), kind="stable")
    logs = np.log((grams + PRIOR) / (grams.sum(axis=0) + PRIOR * (1 << GRAM_BITS)))
    seen = (scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)) & (scripts > 0)
    return Model(tuple(langs[i] for i in order), logs[:, order].astype(np.float32), seen[:, order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, lang_pred, score and spans (lang, start, end in code points)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label(shared.value, batch.column(1).to_pylist())
            spans = [[{"lang": k, "start": a, "end": b} for k, a, b in s] for _, _, s in found]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, span)], ["id", "lang_pred", "score", "spans"])

    return docs.mapInArrow(trimmed(run), f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
