"""Words of UTF-8 texts and their 64-bit hashes, over whole batches of texts at once with numpy.

A word is a longest run of bytes of a class. Both classes here are ASCII rules in which every byte
of a non-ASCII character belongs to words, so words never cut a character.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

U = np.uint64
CHUNK = 1 << 18
LONG_WORD = 1 << 16


def byte_class(name: str) -> np.ndarray:
    """alnum: digits, lower-case letters and bytes from 0x80. nonspace: all but space, 0x09-0x0D."""
    yes = np.zeros(256, bool)
    if name == "alnum":
        yes[0x30:0x3A] = yes[0x61:0x7B] = yes[0x80:] = True
    else:
        yes[:] = True
        yes[0x20] = yes[0x09:0x0E] = False
    return yes


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over the output (shifts and odd multipliers)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[U(1)], np.full(CHUNK + LONG_WORD, U(base))]))
        back = np.cumprod(np.concatenate([[U(1)], np.full(CHUNK + LONG_WORD, U(inverse))]))
        letter = mix(np.arange(1, 257, dtype=U) * U(base))
    return power, back, letter


def _hash_long(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _piece(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, back, letter = _tables()
    edge = np.diff(inside[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum(letter[buf] * power[: len(buf)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))
    return starts, ends, h


def text_words(texts: list[bytes], kind: str = "alnum") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the (lower-cased) texts in order, and where each text's words begin.

    The second array has one entry more than texts. Work arrays stay at a few MB whatever the texts'
    lengths: texts are joined up to CHUNK bytes, longer ones are cut between words.
    """
    inside = byte_class(kind)
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) + 1 <= CHUNK):
            size += len(texts[to]) + 1
            to += 1
        if size <= CHUNK + 1:
            starts, _, h = _piece(np.frombuffer(b"\n".join(texts[at:to]), np.uint8), inside)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
            counts[at + 1 : to + 1] = np.diff(np.searchsorted(starts, begins))
            hashes.append(h)
        else:
            parts = list(_long_text(texts[at], inside))
            counts[at + 1] = sum(map(len, parts))
            hashes += parts
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, U), np.cumsum(counts)


def _long_text(text: bytes, inside: np.ndarray):
    buf, at = np.frombuffer(text, np.uint8), 0
    while at < len(buf):
        to = min(at + CHUNK, len(buf))
        if to < len(buf):
            gaps = np.flatnonzero(~inside[buf[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word fills the chunk: find its end
                while to < len(buf) and inside[buf[to]]:
                    to += 1
        if to - at > CHUNK:
            yield np.array([_hash_long(text[at:to])], U)
        else:
            starts, ends, h = _piece(buf[at:to], inside)
            for i in np.flatnonzero(ends - starts > LONG_WORD):
                h[i] = _hash_long(text[at + int(starts[i]) : at + int(ends[i])])
            yield h
        at = to


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; the caller leaves out those across two texts."""
    if len(words) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, U)
        for i in range(n):
            h = (h + words[i : len(words) - n + 1 + i]) * U(0xD6E8FEB86659FD93 + 2 * i)
        return mix(h)


def starts_of_grams(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of grams(words, n) lie within one text (mask), and to which text each kept one belongs."""
    total = int(offsets[-1])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if total < n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    keep = text[: total - n + 1] == text[n - 1 :]
    return keep, text[: total - n + 1][keep]
