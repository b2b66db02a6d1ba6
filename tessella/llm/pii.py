"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, schemes and identifier
cues. At each anchor a deterministic parser grows the span to its boundaries on both sides and
validates it (label structure, octets, Luhn, digit counts, IBAN remainder). Anchors inside what a
parser has consumed are skipped, and a parser that fails has walked no further than to the next place
where another of its kind could begin (or over 35 letters and digits), so that time is linear in the text.

Kinds email, ip, card and phone follow fixed rules (leftmost, non-overlapping per kind, failing
matches dropped without a retry). The method adds url (scheme and authority up to white space) and
account (an identifier behind a cue such as iban, account or ssn; an IBAN must have remainder 1).

Defined cases: null and empty texts have no spans; ids may be null or repeated; positions are code
points, ends exclusive; equal starts are ordered by kind in the order of KINDS.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import bounded_batches

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
DIGIT = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGIT
LOCAL, LABEL, PHONE = ALNUM | set("._%+-"), ALNUM | {"-"}, DIGIT | set(" ().-")
SCHEMES = ("http", "https", "ftp", "ssh", "sftp", "postgres", "mysql", "mongodb", "redis", "amqp")
CUES = ("iban", "account", "acct", "ssn", "passport")
END_OF_URL = frozenset(" \t\r\n\x0b\x0c\"'<>`")
LONGEST_SCHEME = max(map(len, SCHEMES))
CUE_GAP = frozenset(" :=#")
Span = tuple[int, int]


@cache
def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for text in ("@", "+", "://", *DIGIT):
        auto.add_word(text, "0" if text in DIGIT else text)
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            auto.add_word(form, "cue:" + cue)
    auto.make_automaton()
    return auto


def run(text: str, at: int, allowed: frozenset | set) -> int:
    """The end of the run of allowed characters from at."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> Span | None:
    """Around the at-sign at `at`; the local part may not begin before floor."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    end = run(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (to := run(text, end + 1, LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (begin, end) if labels else None


def addresses(text: str, at: int) -> tuple[list[Span], int]:
    """The dotted quads in the chain of digit runs from at (a run's first digit); where the chain ends."""
    runs, end = [], at
    while True:
        to = run(text, end, DIGIT)
        runs.append((end, to))
        if not (to + 1 < len(text) and text[to] == "." and text[to + 1] in DIGIT):
            break
        end = to + 1
    quads = [runs[i : i + 4] for i in range(0, len(runs) - 3, 4)]
    good = [(q[0][0], q[3][1]) for q in quads if all(octet(text[a:b]) for a, b in q)]
    return good, runs[-1][1]


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def card(text: str, at: int) -> tuple[Span | None, int]:
    """The digits with single separators from at; where they end."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGIT:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return ((at, end) if 12 <= len(digits) <= 19 and luhn(digits) else None), end


def phone(text: str, at: int) -> tuple[Span | None, int]:
    """From the plus sign at `at`; where a match, good or not, ends."""
    if at + 1 >= len(text) or text[at + 1] not in DIGIT:
        return None, at + 1
    end = run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGIT:
        end -= 1
    if end < at + 4:  # at least one character between the first and the last digit
        return None, at + 1
    good = 9 <= sum(c in DIGIT for c in text[at:end]) <= 15
    return ((at, end) if good else None), end


def url(text: str, at: int, floor: int) -> Span | None:
    """Around the :// at `at`: a known scheme before it, anything but white space and quotes behind it.

    The scheme is looked at first, so that only what becomes a span (or has nothing but punctuation) is walked.
    """
    begin = at
    while begin > max(floor, at - LONGEST_SCHEME - 1) and text[begin - 1] in ALNUM:
        begin -= 1
    if text[begin:at].lower() not in SCHEMES:
        return None
    end = at + 3
    while end < len(text) and text[end] not in END_OF_URL:
        end += 1
    while end > at + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (begin, end) if end > at + 3 else None


def account(text: str, at: int, cue: str) -> Span | None:
    """The identifier behind a cue that ends at `at`: 6 to 34 letters and digits, 4 digits at least.

    The cue is a word of its own: no letter or digit is before or behind it. The walk ends at the 35th letter or digit, whatever follows.
    """
    if at < len(text) and text[at] in ALNUM or at > len(cue) and text[at - len(cue) - 1] in ALNUM:
        return None
    begin = end = run(text, at, CUE_GAP)
    n = 0
    while end < len(text) and text[end] in LABEL:
        n += text[end] != "-"
        if n > 34:
            return None
        end += 1
    while end > begin and text[end - 1] == "-":
        end -= 1
    plain = text[begin:end].replace("-", "")
    if len(plain) < 6 or sum(c in DIGIT for c in plain) < 4:
        return None
    if cue == "iban":
        moved = (plain[4:] + plain[:4]).upper()
        if not (plain[:2].isalpha() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1):
            return None
    if cue == "ssn" and len(plain) != 9:
        return None
    return begin, end


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)

    def add(kind: str, span: Span | None) -> None:
        if span:
            out.append((span[0], KINDS.index(kind), span[1]))
            done[kind] = span[1]

    for last, what in automaton().iter(text):
        if what == "0":
            if last >= done["ip"] and last + 1 < len(text) and text[last + 1] == ".":
                begin = last
                while begin > done["ip"] and text[begin - 1] in DIGIT:
                    begin -= 1
                good, end = addresses(text, begin)
                for span in good:
                    add("ip", span)
                done["ip"] = end
            if last >= done["card"]:
                span, end = card(text, last)
                add("card", span)
                done["card"] = end
        elif what == "@":
            add("email", email(text, last, done["email"]))
        elif what == "+":
            if last >= done["phone"]:
                span, end = phone(text, last)
                add("phone", span)
                done["phone"] = end
        elif what == "://":
            if last - 2 >= done["url"]:
                add("url", url(text, last - 2, done["url"]))
        elif last >= done["account"]:
            add("account", account(text, last + 1, what[4:]))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


SPAN_DDL = "array<struct<kind:string,start:int,end:int,value:string>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col and spans (kind, start, end, value)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, span)], ["id", "spans"])

    return docs.mapInArrow(scan, f"id {kind}, spans {SPAN_DDL}").withColumnRenamed("id", id_col)
