"""SentencePiece encoding and decoding with a batched numpy Viterbi.

The model file gives pieces, scores and types. A text's spaces become the meta symbol (one is put in
front, as the model says) and the text is cut where a meta symbol follows another character: no
piece crosses such a place, so that the best segmentation of the parts is the best of the whole.
Control characters that no piece has are parts of their own for the same reason.
Distinct parts ("words") of equal length advance together: at each place the substring hashes of
every piece length are probed in the sorted hashes of the pieces, and the maxima of score and its
backpointer are taken for all words at once. A character without a piece becomes its bytes' pieces.
Among equal scores the longer last piece wins. Hits are compared with the piece's own characters.

The segmentation has the largest sum of the model's scores. For a model trained as BPE that is not
its library's merge order; ids and round trip are well defined all the same.

Defined cases: a null text gives null ids, an empty text none; ids decode to the text itself
(meta symbols that a text has of its own come back as spaces).
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import bounded_batches, trimmed
from tessella.llm.wordhash import U, mix

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED_WORDS = 200_000
BYTE_SCORE = -1e6
GROUP_CHARS = 1 << 16
#: Characters of texts that are cut into words at once.
GROUP_TEXT = 1 << 18


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protocol buffer message: ints, floats' bytes and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


@cache
def load(path: str) -> Model:
    return Model(path)


class Model:
    """Pieces by id, and sorted hashes of those that text can match."""

    def __init__(self, path: str):
        self.pieces, self.scores, self.kinds, self.dummy_prefix, self.remove_extra = [], [], [], True, True
        for field, value in _wire(open(path, "rb").read()):
            if field == 1:
                own = dict(_wire(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 3:
                own = dict(_wire(value))
                self.dummy_prefix, self.remove_extra = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("the model normalises characters, which is not supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        inside = {c for i in usable for c in self.pieces[i]}
        # Line breaks and the like, in no piece, are parts of their own.
        lone = "".join(re.escape(c) for c in map(chr, range(0x20)) if c not in inside)
        self.part = re.compile(f"{META}*[^{META}{lone}]+|{META}+" + (f"|[{lone}]" if lone else ""))
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        plain = np.array([k not in (BYTE, CONTROL, UNKNOWN) for k in self.kinds])
        self.table = np.array(self.pieces, object), plain  # pieces, and whether their characters are the text's
        by_length: dict[int, list[int]] = {}
        for i in usable:
            by_length.setdefault(len(self.pieces[i]), []).append(i)
        self.by_length = {}
        for n, ids in sorted(by_length.items()):
            chars = np.array([[ord(c) for c in self.pieces[i]] for i in ids], np.uint32)
            h = substring_hashes(chars, n)[:, 0]
            order = np.argsort(h)
            ids = np.array(ids)[order]
            self.by_length[n] = (h[order], ids.astype(np.int32), np.array([self.scores[i] for i in ids]), chars[order])


def substring_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Of each row's substrings of length n, by their first place."""
    with np.errstate(over="ignore"):
        h = np.zeros((len(chars), chars.shape[1] - n + 1), U)
        for i in range(n):
            h = h * U(0x100000001B3) + chars[:, i : i + h.shape[1]]
        return mix(h + U(n))


def viterbi(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of one length, one word after another, and each word's number of ids."""
    n, rows = len(words[0]), len(words)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(rows, n)
    best = np.full((rows, n + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((rows, n + 1), np.int32)  # the last piece's length; 0: bytes
    piece = np.full((rows, n + 1), -1, np.int32)
    found = {}
    for m, (keys, ids, scores, own) in model.by_length.items():
        if m > n:
            break
        h = substring_hashes(chars, m)
        at = np.minimum(np.searchsorted(keys, h.ravel()), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h.ravel())
        row, place = np.divmod(hit, h.shape[1])
        same = (chars[row[:, None], place[:, None] + np.arange(m)] == own[at[hit]]).all(axis=1)
        hit, row, place = hit[same], row[same], place[same]
        score = np.full(h.shape, -np.inf)
        which = np.full(h.shape, -1, np.int32)
        score[row, place], which[row, place] = scores[at[hit]], ids[at[hit]]
        if len(hit):
            found[m] = (score, which)
    size = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
    for end in range(1, n + 1):
        top = best[:, end - 1] + BYTE_SCORE * size[:, end - 1]
        length, last = np.zeros(rows, np.int32), np.full(rows, -1, np.int32)
        for m, (score, which) in found.items():
            if m > end:
                break
            total = best[:, end - m] + score[:, end - m]
            better = (total >= top) & np.isfinite(total)
            top = np.where(better, total, top)
            length[better] = m
            last[better] = which[better, end - m]
        best[:, end], back[:, end], piece[:, end] = top, length, last
    at, lanes = np.full(rows, n), np.arange(rows)
    steps = []
    while len(lanes):
        ends = at[lanes]
        steps.append((lanes, piece[lanes, ends], chars[lanes, ends - 1]))
        at[lanes] = ends - np.maximum(back[lanes, ends], 1)
        lanes = lanes[at[lanes] > 0]
    row, ids, char = (np.concatenate([s[i] for s in reversed(steps)]) for i in range(3))
    order = np.argsort(row, kind="stable")  # by word, each from its first piece on
    row, ids, char = row[order], ids[order], char[order]
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        raw = [chr(c).encode() for c in char[lost].tolist()]
        count = np.ones(len(ids), np.int64)
        count[lost] = [len(x) for x in raw]
        places = np.repeat(ids < 0, count)
        row, ids = np.repeat(row, count), np.repeat(ids, count)
        ids[places] = model.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(row, minlength=rows)


def segment(model: Model, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words by length, their ids one after another and each one's number of ids.

    Those of equal length go together, in groups of bounded size.
    """
    words = sorted(words, key=len)
    ids, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < len(words):
        n = len(words[at])
        to = min(bisect_right(words, n, lo=at, key=len), at + max(1, GROUP_CHARS // n))
        own, count = viterbi(model, words[at:to])
        ids.append(own)
        counts.append(count)
        at = to
    return words, np.concatenate(ids), np.concatenate(counts)


def prepared(model: Model, text: str) -> str:
    if model.remove_extra:
        text = re.sub(" +", " ", text).strip(" ")
    text = text.replace(" ", META)
    return META + text if model.dummy_prefix and text else text


class Encoder:
    """Ids of texts; distinct words are segmented once while they are remembered.

    Texts are cut into words in groups of bounded size, of which only the words' numbers are kept. The new
    words of all groups are segmented together. Beyond CACHED_WORDS only words that the last call met again are kept.
    """

    def __init__(self, path: str):
        self.model = load(path)
        self.known: dict[str, int] = {}  # numbers in order
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.uses > 1) if (self.uses > 1).sum() <= CACHED_WORDS // 2 else np.zeros(0, np.int64)
        again = set(kept.tolist())
        self.known = {w: i for i, w in enumerate([w for w, i in self.known.items() if i in again])}
        begins, sizes = self.begins[kept], self.sizes[kept]
        stops = np.cumsum(sizes, dtype=np.int64)
        self.flat = self.flat[spread(begins, sizes)]
        self.begins, self.sizes = stops - sizes, sizes

    def _learn(self, words: list[str]) -> None:
        """The words that were numbered last."""
        words, ids, counts = segment(self.model, words)
        at = [self.known[w] for w in words]
        begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        at = np.array(at, np.int64) - len(self.begins)
        begins[at], sizes[at] = len(self.flat) + np.cumsum(counts) - counts, counts
        self.flat = np.concatenate([self.flat, ids])
        self.begins, self.sizes = np.concatenate([self.begins, begins]), np.concatenate([self.sizes, sizes])

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[str]]:
        """The texts' words by number, each text's number of words, and those that are new."""
        parts = [self.model.part.findall(prepared(self.model, t)) for t in texts]
        words = [w for p in parts for w in p]
        which = np.array(list(map(self.known.get, words, repeat(-1))), np.int32)
        at = np.flatnonzero(which < 0).tolist()
        new = list({words[i]: None for i in at})
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        which[at] = [self.known[words[i]] for i in at]
        return which, list(map(len, parts)), new

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one entry more)."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        groups, new, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP_TEXT):
                size += len(texts[to])
                to += 1
            which, counts, own = self._numbered(texts[at:to])
            groups.append((which, counts))
            new += own
            at = to
        self._learn(new)
        ids, ends, last = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        self.uses = np.zeros(len(self.known), np.int64)
        for which, counts in groups:
            self.uses += np.bincount(which, minlength=len(self.known))
            sizes = self.sizes[which]
            ids.append(self.flat[spread(self.begins[which], sizes)])
            ends.append(last + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.cumsum(counts)])
            last += len(ids[-1])
        return np.concatenate(ids), np.concatenate(ends)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    stops = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(begins - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)


def decode(model: Model, ids: list[int]) -> str:
    out, raw = [], bytearray()
    for i in ids:
        if model.kinds[i] == BYTE:
            raw.append(int(model.pieces[i][3:5], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        if model.kinds[i] not in (CONTROL, UNKNOWN):
            out.append(model.pieces[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out)
    return (text[1:] if model.dummy_prefix and text.startswith(META) else text).replace(META, " ")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id_col and ids (array<int>)."""
    model = model or default_model()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)  # of this task alone, so that idle workers hold no words
        for batch in batches:
            ids, ends = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            mask = pa.array(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)], ["id", "ids"])

    return docs.mapInArrow(trimmed(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def texts_of(model: Model, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of ids one after another, each up to its end."""
    pieces, plain = model.table
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        own = ids[a:b]
        if plain[own].all():
            text = "".join(pieces[own])
            out.append((text[1:] if model.dummy_prefix and text.startswith(META) else text).replace(META, " "))
        else:
            out.append(decode(model, own.tolist()))
    return out


def decoded(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: id_col and text."""
    model = model or default_model()
    encoded = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ids = column.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in column.to_pylist()])]).astype(np.int64)
            texts = pa.array(texts_of(load(model), ids, ends), pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0), texts], ["id", "text"])

    return encoded.mapInArrow(trimmed(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id_col, ids and round_trip, whether the ids decode to the text (a null text: null).

    Texts with the sign for a blank (U+2581) itself don't: it is decoded as a blank.

    One pass in one worker encodes and decodes.
    """
    model = model or default_model()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends = encoder.encode(texts)
            same = [a == b for a, b in zip(texts_of(encoder.model, ids, ends), texts)]
            lost = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(lost))
            yield pa.record_batch([batch.column(0), column, pa.array(same, pa.bool_(), mask=lost)], ["id", "ids", "round_trip"])

    return docs.mapInArrow(trimmed(run), f"id {kind}, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)
