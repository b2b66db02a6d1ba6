"""Token ids in Arrow files of fixed-size-list batches.

A dataset is a folder with one sequences-N.arrow (IPC file format, uncompressed, so that a memory
map gives its buffers without a copy) and one documents-N.arrow for each shard, and a Parquet
manifest. sequences: ids fixed_size_list<uint16 or uint32>[length], mask fixed_size_list<bool>[length];
the shard's documents follow one another, an end id after each, and only the last row is padded
(mask false). documents: id, start (place of its first id in the shard) and n_tokens. All batches but
a shard's last have the same number of rows, so that row r is row r % rows of batch r // rows.

Shards hold ascending id ranges. Executors write to a name of their own and then move the file, so
that a repeated task leaves one whole file.

Defined cases: a null or empty text is the end id alone; a null id comes first; rows with equal ids
follow the order of their texts' hashes; an empty table gives a manifest without shards.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blocks import key, range_of, ranges
from tessella.llm.storage import bounded_batches

CACHED_WORDS = 800_000
PUNCTUATION = b".,;:!?%$&*#"
MANIFEST = "shard int, documents long, tokens long, start long"


def letters(word: bytes) -> bool:
    """Whether it is letters alone, also as the normaliser leaves it."""
    return word.isalpha() or (not word.isascii() and unicodedata.normalize("NFC", word.decode()).lower().isalpha())


#: Fixed value: a pre-tokenizer's pattern that takes no white space into its pieces and drops it between them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer: dict) -> tuple[bool, bool]:
    """(whether a tokenizer's file says that texts may be encoded word by word, whether it lower-cases)."""
    steps = tokenizer.get("normalizer") or {}
    steps = steps["normalizers"] if steps.get("type") == "Sequence" else [steps] if steps else []
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    cut = tokenizer.get("pre_tokenizer") or {}
    cut = cut["pretokenizers"][0] if cut.get("type") == "Sequence" else cut
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    plain = all(s["type"] in ("NFC", "Lowercase") or s == blanks for s in steps) and not tokenizer.get("post_processor")
    return plain and cut == split, any(s["type"] == "Lowercase" for s in steps)


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct piece between white space.

    That is exact for tokenizers whose pre-tokenizer never joins across white space and drops it, which is read
    from the tokenizer's file; with others, or with whole_words=False, whole texts are encoded.
    """

    def __init__(self, path: str, whole_words: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        fits, self.lower = by_words(json.loads(self.tokenizer.to_str()))
        self.whole_words = whole_words and fits
        model = json.loads(self.tokenizer.to_str())["model"]
        self.ends = None  # by id: whether the token ends a word
        if suffix := model.get("end_of_word_suffix"):
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[bytes, int] = {b"": 0}  # place of a part's ids, which end at ends_at[place]
        self.flat, self.ends_at = np.zeros(1 << 20, self.dtype), np.zeros(CACHED_WORDS, np.int64)
        self.words: dict[bytes, int] = {b"": 0}  # place of a word's two parts
        self.two = np.zeros((CACHED_WORDS, 2), np.int64)

    def _keep(self, parts: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """ids of parts one after another, each up to its end."""
        n = len(self.parts)
        at = self.ends_at[n - 1]
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(parts) > len(self.ends_at):
            self.ends_at = np.concatenate([self.ends_at, np.zeros_like(self.ends_at)])
        self.flat[at : at + len(ids)] = ids
        self.ends_at[n : n + len(parts)] = at + ends
        self.parts.update(zip(parts, range(n, n + len(parts))))

    def _encode(self, parts: list[bytes]) -> None:
        """Letters alone are encoded many at a time, and cut after tokens that end a word."""
        joined = self.ends is not None
        plain = [w for w in parts if joined and letters(w)]
        for i in range(0, len(plain), 2048):
            some = plain[i : i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                self._keep(some, ids, stops)
        rest = [w for w in parts if w not in self.parts]
        for i in range(0, len(rest), 4096):
            done = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest[i : i + 4096]], add_special_tokens=False)]
            self._keep(rest[i : i + 4096], np.array([x for ids in done for x in ids], self.dtype), np.cumsum([len(ids) for ids in done]))

    def _learn(self, words: list[bytes]) -> None:
        """Trailing punctuation behind letters is a pre-token of its own."""
        first, second = list(words), [b""] * len(words)
        if self.ends is not None:
            for i, w in enumerate(words):
                stem = w.rstrip(PUNCTUATION)
                if len(stem) < len(w) and letters(stem):
                    first[i], second[i] = stem, w[len(stem) :]
        self._encode(list({*first, *second} - self.parts.keys()))
        n = len(self.words)
        while n + len(words) > len(self.two):
            self.two = np.concatenate([self.two, np.zeros_like(self.two)])
        for i, own in enumerate((first, second)):
            self.two[n : n + len(words), i] = np.fromiter(map(self.parts.__getitem__, own), np.int64, len(own))
        self.words.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end, and where each text's begin (one entry more)."""
        if not self.whole_words:
            done = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            sizes = [len(e.ids) + 1 for e in done]
            return np.array([i for e in done for i in (*e.ids, end)], self.dtype), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # Spelled-out special tokens are case-sensitive: texts with their first characters keep their case.
        pieces = [(t.lower() if self.lower and b"<|" not in t else t).split() for t in texts]
        words = [w for p in pieces for w in p]
        if len(self.words) > CACHED_WORDS:
            self._clear()
        get = self.words.get
        which = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(which < 0)
        own = [words[i] for i in new.tolist()]
        self._learn(list(set(own)))
        which[new] = np.fromiter(map(get, own), np.int64, len(own))
        parts = self.two[which].ravel()
        stops = self.ends_at[parts]
        starts = self.ends_at[np.maximum(parts - 1, 0)]
        sizes = stops - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[2 * np.cumsum([len(p) for p in pieces], dtype=np.int64)]  # where each text's ids end
        return np.insert(ids, bounds, self.dtype(end)), np.concatenate([[0], bounds + np.arange(1, len(bounds) + 1)])


@cache
def encoder(path: str, whole_words: bool) -> Encoder:
    """A worker's encoder, which later tasks use again."""
    return Encoder(path, whole_words)


class _Shard:
    """Writes one shard; ids wait until they fill a batch."""

    def __init__(self, base: str, shard: int, dtype: type, id_type: pa.DataType, length: int, rows: int):
        self.fs, self.base = pafs.FileSystem.from_uri(base)
        self.shard, self.length, self.rows, self.own = shard, length, rows, uuid.uuid4().hex
        self.kind = pa.from_numpy_dtype(dtype)
        self.schemas = {"sequences": pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))]), "documents": pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])}
        self.files = {k: self.fs.open_output_stream(self._path(k, True)) for k in self.schemas}
        self.out = {k: ipc.new_file(self.files[k], s) for k, s in self.schemas.items()}
        self.waiting, self.tokens, self.documents = np.zeros(0, dtype), 0, 0

    def _path(self, kind: str, own: bool = False) -> str:
        return f"{self.base}/" + (f"_{self.own}-" if own else "") + f"{kind}-{self.shard:06d}.arrow"

    def add(self, ids: pa.Array, tokens: np.ndarray, begins: np.ndarray) -> None:
        self.out["documents"].write_batch(pa.record_batch([ids, pa.array(begins[:-1] + self.tokens), pa.array(np.diff(begins))], schema=self.schemas["documents"]))
        self.waiting = np.concatenate([self.waiting, tokens])
        self.tokens, self.documents = self.tokens + len(tokens), self.documents + len(ids)
        size = self.rows * self.length
        for at in range(0, len(self.waiting) - size + 1, size):
            self._write(self.waiting[at : at + size], size)
        self.waiting = self.waiting[len(self.waiting) // size * size :].copy()

    def _write(self, tokens: np.ndarray, used: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(tokens), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(tokens)) < used), self.length)
        self.out["sequences"].write_batch(pa.record_batch([ids, mask], schema=self.schemas["sequences"]))

    def close(self) -> None:
        if used := len(self.waiting):
            self._write(np.concatenate([self.waiting, np.zeros(-used % self.length, self.waiting.dtype)]), used)
        for kind in self.schemas:
            self.out[kind].close()
            self.files[kind].close()
            self.fs.move(self._path(kind, True), self._path(kind))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, length: int = 2048, rows: int = 64, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = True) -> DataFrame:
    """Writes the dataset to path (a URI that pyarrow.fs opens on every executor); returns its manifest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    found = ranges(docs, id_col)
    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(tokenizer, whole_words), None
        number = TaskContext.get().partitionId()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            shard = shard or _Shard(path, number, own.dtype, batch.column(0).type, length, rows)
            shard.add(batch.column(0), *own.encode(texts, end_id))
        if shard:
            shard.close()
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([shard.documents]), pa.array([shard.tokens])], ["shard", "documents", "tokens"])

    done = []
    if found:
        k = key(id_col)
        rows_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), k.alias("k"), range_of(found, k).alias("r"))
        dealt = rows_.repartitionById(len(found), F.col("r")).sortWithinPartitions("k", F.xxhash64("text"), "text").select("id", "text")
        done = sorted(dealt.mapInArrow(write, "shard int, documents long, tokens long").collect())
    starts = np.concatenate([[0], np.cumsum([r.tokens for r in done])]).astype(int).tolist()
    manifest = spark.createDataFrame([(r.shard, r.documents, r.tokens, s) for r, s in zip(done, starts)], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return manifest


def open_shard(path: str, kind: str, shard: int) -> ipc.RecordBatchFileReader:
    """A shard's file, memory-mapped where it is local."""
    fs, base = pafs.FileSystem.from_uri(path)
    name = f"{base}/{kind}-{shard:06d}.arrow"
    return ipc.open_file(pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name))


def sequence(reader: ipc.RecordBatchFileReader, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one row of a sequences file; the ids are a view of the file's buffer."""
    rows = reader.get_batch(0).num_rows
    batch, at = reader.get_batch(row // rows), row % rows
    length = batch.schema.field("ids").type.list_size
    ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[at * length : (at + 1) * length]
    return ids, batch.column(1).flatten().slice(at * length, length).to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    manifest = sorted(spark.read.parquet(f"{path}/manifest").collect())
    shards = [(r.shard, r.start) for r in manifest]
    if not shards:
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                shard, base = shards[i]
                index, data = open_shard(path, "documents", shard), open_shard(path, "sequences", shard)
                held, first, b = np.zeros(0, np.uint32), 0, 0  # ids read and not yet used, and their place
                for j in range(index.num_record_batches):
                    part = index.get_batch(j)
                    starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                    stop = int(starts[-1] + sizes[-1]) if len(starts) else first
                    parts = [held[int(starts[0]) - first :]] if len(starts) else [held]
                    have = first + len(held)
                    while have < stop:
                        more = data.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)
                        parts.append(more.astype("<u4"))
                        have, b = have + len(more), b + 1
                    first = int(starts[0]) if len(starts) else first
                    held = np.concatenate(parts)
                    out = [held[s - first : s - first + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(starts + base), part.column(2), pa.array(out, pa.binary())], ["id", "start", "n_tokens", "ids"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, "id long, start long, n_tokens long, ids binary")
