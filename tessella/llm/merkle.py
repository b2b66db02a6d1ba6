"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves. A text is cut after each line break (of several lines of white space in a row only after the last), and within lines after the blank behind a word at which
the 8 bytes before it hash to a multiple of 8, so that a paragraph of one long line has leaves too and
an edit moves no cut but its own. Leaves cover the text; a leaf's hash is the SHA-256 of its bytes.
Sections. A section ends before a heading (a line that begins with #), after a line of white space and
after a leaf whose hash begins with a byte under 16; its hash is over its leaves' hashes, the root's
over its sections'.
A fingerprint is the whole tree as a string: the root's 64 hex digits, then for each section / and 16
digits of its hash, then for each of its leaves . with 8 digits of its hash and its length in code
points (hex). So two fingerprints alone tell, from the root down, whether texts are equal, how like they
are and where they differ: sections with equal hashes agree as a whole, of the others' leaves those that
both have agree. The likeness is the agreeing leaves' length by the length of both trees' leaves together
(weighted Jaccard); it is below 1 for different texts.

Defined cases: a null text counts as empty (a root without sections); a null id sorts as the least;
rows with equal ids follow the order of their texts' hashes; a table of one row is its own next; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import key, range_and_next, ranges
from tessella.llm.storage import bounded_batches

CUT_BYTES, CUT_ONE_IN, SECTION_BYTE = 8, 8, 16
#: Odd multipliers of the bytes before a cut, the nearest first; the sum's high bits decide.
CUT_FACTORS = np.array([0x9E3779B1 * (2 * i + 1) % (1 << 32) | 1 for i in range(CUT_BYTES)], np.uint64)
BLANKS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
Leaf = tuple[str, int]  # 8 hex digits, code points
Span = tuple[int, int]


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def cuts(text: bytes) -> np.ndarray:
    """Where the leaves end, in bytes."""
    buf = np.frombuffer(text, np.uint8)
    blank = BLANKS[buf]
    after = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # the blank behind a word
    padded = np.concatenate([np.zeros(CUT_BYTES, np.uint8), buf]).astype(np.uint64)
    value = np.zeros(len(after), np.uint64)
    for i, factor in enumerate(CUT_FACTORS):
        value += padded[after + CUT_BYTES - 1 - i] * factor
    own = after[(value >> np.uint64(20)) % np.uint64(CUT_ONE_IN) == 0] + 1
    ends = np.unique(np.append(np.flatnonzero(buf == 10) + 1, len(buf)))
    words = np.concatenate([[0], np.cumsum(~blank)])
    empty = np.diff(words[np.concatenate([[0], ends])]) == 0  # lines of white space
    return np.union1d(own, ends[~(empty & np.append(empty[1:], False))])


@dataclass(frozen=True)
class Tree:
    """A root and sections: (16 hex digits, leaves)."""

    root: str
    sections: list[tuple[str, list[Leaf]]]

    @classmethod
    def of(cls, text: bytes) -> Tree:
        if not text:
            return cls(sha(b"r").hex(), [])
        ends = cuts(text)
        chars = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)[ends - 1]
        groups: list[list[tuple[bytes, int]]] = [[]]
        at = 0
        for end, n in zip(ends.tolist(), np.diff(chars, prepend=0).tolist()):
            leaf = text[at:end]
            found = sha(leaf)
            line = at == 0 or text[at - 1] == 10
            if line and leaf[0] == 0x23 and groups[-1]:
                groups.append([])
            groups[-1].append((found, n))
            if found[0] < SECTION_BYTE or (line and not leaf.strip()):
                groups.append([])
            at = end
        groups = [g for g in groups if g]
        hashes = [sha(b"s" + b"".join(leaf for leaf, _ in g)) for g in groups]
        return cls(sha(b"r" + b"".join(hashes)).hex(), [(h.hex()[:16], [(leaf.hex()[:8], n) for leaf, n in g]) for h, g in zip(hashes, groups)])

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        root, *sections = fingerprint.split("/")
        parts = [s.split(".") for s in sections]
        return cls(root, [(p[0], [(x[:8], int(x[8:], 16)) for x in p[1:]]) for p in parts])

    @cached_property
    def fingerprint(self) -> str:
        return self.root + "".join("/" + h + "".join(f".{leaf}{n:x}" for leaf, n in leaves) for h, leaves in self.sections)

    @cached_property
    def length(self) -> int:
        return sum(n for _, leaves in self.sections for _, n in leaves)

    def branches(self, other: Tree) -> list[tuple[int, list[Leaf]]]:
        """The sections that other lacks (of several equal ones as many as it lacks): place in code points, leaves."""
        have, at, out = Counter(h for h, _ in other.sections), 0, []
        for h, leaves in self.sections:
            if have[h]:
                have[h] -= 1
            else:
                out.append((at, leaves))
            at += sum(n for _, n in leaves)
        return out

    def likeness(self, other: Tree) -> float:
        if self.root == other.root:
            return 1.0
        own, theirs = self.branches(other), other.branches(self)
        common = self.length - sum(n for _, leaves in own for _, n in leaves)
        left = Counter(x for _, leaves in own for x in leaves)
        common += sum(n * min(c, left[leaf, n]) for (leaf, n), c in Counter(x for _, leaves in theirs for x in leaves).items())
        return common / max(self.length + other.length - common, common + 1)

    def changes(self, old: Tree) -> list[Span]:
        """The spans (code points, joined) of this tree's leaves in branches that old lacks, less those leaves that old's other branches have."""
        if self.root == old.root:
            return []
        have = Counter(x for _, leaves in old.branches(self) for x in leaves)
        spans: list[Span] = []
        for at, leaves in self.branches(old):
            for leaf in leaves:
                end = at + leaf[1]
                if have[leaf]:
                    have[leaf] -= 1
                elif spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((at, end))
                at = end
        return spans


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    return Tree.read(a).likeness(Tree.read(b))


def changes(old: str, new: str) -> list[Span]:
    """Where the text of fingerprint new differs from that of old: spans in code points."""
    return Tree.read(new).changes(Tree.read(old))


SPANS = "array<struct<start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def as_spans(spans: list[Span]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_chars and fingerprint."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [Tree.of(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([t.length for t in trees], pa.int64()), pa.array([t.fingerprint for t in trees], pa.string())], ["id", "n_chars", "fingerprint"])

    return docs.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def locate_edits(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id in both tables whose texts differ: likeness and edits, the new text's changed spans in code points.

    Only fingerprints are joined, no texts. Repeated ids give all their combinations.
    """
    left = fingerprints(old, id_col, text_col).select(F.col(id_col).alias("id"), F.col("fingerprint").alias("a"))
    right = fingerprints(new, id_col, text_col).select(F.col(id_col).alias("id"), F.col("fingerprint").alias("b"))
    both = left.join(right, "id").where("substring(a, 1, 64) <> substring(b, 1, 64)").select("id", "a", "b")
    kind = both.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(Tree.read(a), Tree.read(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array([a.likeness(b) for a, b in pairs], pa.float64()), pa.array([as_spans(b.changes(a)) for a, b in pairs], SPAN_TYPE)], ["id", "likeness", "edits"])

    return both.mapInArrow(run, f"id {kind}, likeness double, edits {SPANS}").withColumnRenamed("id", id_col)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row against the next in descending id order (after the last: the first) and against its own edit.

    The edit replaces the last half (floor) of the code points by as many first ones of the next text;
    edits are the spans in which the edited text's tree differs.
    Texts are shuffled once, to ascending id ranges; the row with a range's largest id goes to the
    following range too, whose least id it follows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = ranges(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits {SPANS}"
    if not found:
        return spark.createDataFrame([], ddl).withColumnRenamed("id", id_col)
    k = key(id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), k.alias("k"), range_and_next(found, k).alias("to"))
    rows = rows.select("id", "text", "k", F.posexplode("to").alias("guest", "r"))
    dealt = rows.repartitionById(len(found), F.col("r")).sortWithinPartitions("guest", F.desc("k"), F.xxhash64("text"), "text").select("id", "text", "guest")
    alone = len(found) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, whose next is still to come
        first, over, id_type = None, False, pa.int64()

        def result(rows: list[tuple]) -> pa.RecordBatch:
            """Of all rows but the last, which is the next of the one before it. A row: id, text, tree."""
            own, after = rows[:-1], rows[1:]
            n = [len(r[1]) for r in own]
            new = [(r[1][: c - c // 2] + s[1][: c // 2]).encode() for r, s, c in zip(own, after, n)]
            trees = [Tree.of(t) for t in new]
            columns = {
                "id": pa.array([r[0] for r in own], id_type),
                "n_chars": pa.array(n, pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in new]),
                "fingerprint": pa.array([r[2].fingerprint for r in own]),
                "edited_fingerprint": pa.array([t.fingerprint for t in trees]),
                "near_edited": pa.array([r[2].likeness(t) for r, t in zip(own, trees)], pa.float64()),
                "near_next": pa.array([r[2].likeness(s[2]) for r, s in zip(own, after)], pa.float64()),
                "edits": pa.array([as_spans(t.changes(r[2])) for r, t in zip(own, trees)], SPAN_TYPE),
            }
            return pa.record_batch(list(columns.values()), list(columns))

        for batch in batches:
            if over:
                continue
            id_type = batch.column(0).type
            texts = batch.column(1).to_pylist()
            rows = held + [(i, t, Tree.of(t.encode())) for i, t in zip(batch.column(0).to_pylist(), texts)]
            guests = batch.column(2).to_pylist()
            if 1 in guests:  # of several guests the first is the next
                rows, over = rows[: len(held) + guests.index(1) + 1], True
            first = first or rows[0]
            if len(rows) > 1:
                yield result(rows)
            held = rows[-1:]
        if held and alone:
            yield result([held[0], first])

    return dealt.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
