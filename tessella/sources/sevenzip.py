"""7z archives as a Spark source: a task for each solid block, entries streamed one by one.

Blocks with one coder are read (copy, LZMA, LZMA2, Deflate, BZip2); others, and encrypted ones, fail.
An entry's crc32 is the archive's own and is held against the content.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.model import LEAF_ZOOM
from tessella.sources.archives import DDL, ENTRY, opened

MAGIC = b"7z\xbc\xaf\x27\x1c"
#: Fixed values of the format: property ids.
END, HEADER, STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, CODER_SIZES, COUNTS, EMPTY, NAMES, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 23
CHUNK = 1 << 20


@dataclass
class Block:
    """A packed stream with its coder and the files in it."""

    at: int = 0
    packed: int = 0
    coder: bytes = b""
    settings: bytes = b""
    size: int = 0
    crc: int | None = None
    files: list[tuple[int, int | None]] = field(default_factory=list)  # size, crc
    names: list[str] = field(default_factory=list)


class Fields:
    """A header's bytes, read in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("the archive's header ends early")
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """As many further bytes as the first one has leading ones; its other bits are the highest."""
        first = self.byte()
        more = 8 - (first ^ 0xFF).bit_length()
        low = int.from_bytes(self.take(more), "little")
        return low if more >= 7 else low | (first & (0x7F >> more)) << 8 * more

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def checksums(self, n: int) -> list[int | None]:
        known = [True] * n if self.byte() else self.bits(n)
        return [struct.unpack("<I", self.take(4))[0] if k else None for k in known]


def _folder(f: Fields) -> Block:
    if f.number() != 1:
        raise ValueError("a block with several coders")
    flags = f.byte()
    block = Block(coder=f.take(flags & 15))
    if flags & 16:
        raise ValueError("a coder with several streams")
    block.settings = f.take(f.number()) if flags & 32 else b""
    return block


def _streams(f: Fields) -> list[Block]:
    blocks: list[Block] = []
    where, sizes, split = 0, [], False
    while (kind := f.number()) != END:
        if kind == PACK:
            where, n = f.number(), f.number()
            while (kind := f.number()) != END:
                if kind == SIZE:
                    sizes = [f.number() for _ in range(n)]
                elif kind == CRC:
                    f.checksums(n)
        elif kind == UNPACK:
            while (kind := f.number()) != END:
                if kind == FOLDER:
                    n = f.number()
                    f.byte()
                    blocks = [_folder(f) for _ in range(n)]
                elif kind == CODER_SIZES:
                    for b in blocks:
                        b.size = f.number()
                elif kind == CRC:
                    for b, crc in zip(blocks, f.checksums(len(blocks))):
                        b.crc = crc
        elif kind == SUBSTREAMS:
            split = True
            _substreams(f, blocks)
    for b, size in zip(blocks, sizes):
        b.at, b.packed = 32 + where, size
        where += size
        b.files = b.files if split else [(b.size, b.crc)]
    return blocks


def _substreams(f: Fields, blocks: list[Block]) -> None:
    counts, kind = [1] * len(blocks), f.number()
    if kind == COUNTS:
        counts, kind = [f.number() for _ in blocks], f.number()
    sizes = [[] for _ in blocks]
    for b, n, own in zip(blocks, counts, sizes):
        own += [f.number() for _ in range(n - 1)] if kind == SIZE else []
        own += [b.size - sum(own)] if n else []
    kind = f.number() if kind == SIZE else kind
    crcs = [[b.crc] if n == 1 and b.crc is not None else [None] * n for b, n in zip(blocks, counts)]
    while kind != END:
        if kind == CRC:
            open_ = [(i, j) for i, c in enumerate(crcs) for j, v in enumerate(c) if v is None]
            for (i, j), v in zip(open_, f.checksums(len(open_))):
                crcs[i][j] = v
        kind = f.number()
    for b, own, c in zip(blocks, sizes, crcs):
        b.files = list(zip(own, c))


def _names(f: Fields, blocks: list[Block]) -> None:
    n, names, empty = f.number(), [], []
    while (kind := f.number()) != END:
        part = Fields(f.take(f.number()))
        if kind == NAMES:
            part.byte()
            names = part.data[1:].decode("utf-16-le").split("\0")[:n]
        elif kind == EMPTY:
            empty = part.bits(n)
    full = iter([name for i, name in enumerate(names) if not (empty and empty[i])])
    for b in blocks:
        b.names = [next(full) for _ in b.files]


def contents(stream: BinaryIO) -> list[Block]:
    """The archive's blocks with names, sizes and checksums."""
    head = stream.read(32)
    if head[:6] != MAGIC:
        raise ValueError("not a 7z archive")
    at, size, crc = struct.unpack("<QQI", head[12:32])
    if not size:
        return []
    stream.seek(32 + at)
    data = stream.read(size)
    if len(data) < size or zlib.crc32(data) != crc:
        raise ValueError("the archive's header is damaged")
    f = Fields(data)
    while (kind := f.number()) == ENCODED:
        block = _streams(f)[0]
        f = Fields(b"".join(unpacked(stream, block)))
    if kind != HEADER:
        raise ValueError("no header in the archive")
    blocks: list[Block] = []
    while (kind := f.number()) != END:
        if kind == STREAMS:
            blocks = _streams(f)
        elif kind == FILES:
            _names(f, blocks)
        else:
            raise ValueError(f"header part {kind}")
    return blocks


def decoder(block: Block):
    if block.coder == b"\x21":
        bits = block.settings[0]
        size = 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << bits // 2 + 11
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": size}])
    if block.coder == b"\x03\x01\x01":
        d, size = block.settings[0], struct.unpack("<I", block.settings[1:5])[0]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": size}])
    if block.coder == b"\x04\x01\x08":
        return zlib.decompressobj(-15)
    if block.coder == b"\x04\x02\x02":
        return bz2.BZ2Decompressor()
    if block.coder == b"\x00":
        return None
    raise ValueError(f"coder {block.coder.hex()}")


def pieces_of(tool, data: bytes) -> Iterator[bytes]:
    """What some packed bytes unpack to, about CHUNK bytes at a time however well they were packed."""
    if tool is None:
        yield data
    elif hasattr(tool, "unconsumed_tail"):
        while True:
            out = tool.decompress(data, CHUNK)
            yield out
            data = tool.unconsumed_tail
            if not data and len(out) < CHUNK:
                return
    else:
        yield tool.decompress(data, CHUNK)
        while not tool.needs_input and not tool.eof:
            yield tool.decompress(b"", CHUNK)


def unpacked(stream: BinaryIO, block: Block) -> Iterator[bytes]:
    """A block's plain bytes, piece by piece."""
    stream.seek(block.at)
    left, out, tool = block.packed, 0, decoder(block)
    while left and out < block.size:
        data = stream.read(min(CHUNK, left))
        if not data:
            raise ValueError("the archive ends inside a block")
        left -= len(data)
        for piece in pieces_of(tool, data):
            piece = piece[: block.size - out]
            out += len(piece)
            yield piece
    if out < block.size:
        raise ValueError("the archive ends inside a block")


def entries(stream: BinaryIO, block: Block) -> Iterator[tuple[str, int, bytes]]:
    """(name, crc32, content) of a block's files; memory holds one."""
    pieces, held = unpacked(stream, block), bytearray()
    for name, (size, crc) in zip(block.names, block.files):
        while len(held) < size:
            held += next(pieces)
        data = bytes(held[:size])
        del held[:size]
        found = zlib.crc32(data)
        if crc is not None and crc != found:
            raise ValueError(f"{name}: checksum")
        yield name, found, data


class SevenZipReader(DataSourceReader):
    def __init__(self, path: str, mode: str):
        self.path, self.mode = path, mode

    def partitions(self) -> list[InputPartition]:
        fs, name = opened(self.path)
        with fs.open_input_file(name) as stream:
            return [InputPartition(i) for i in range(len(contents(stream)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as stream:
            for name, crc, data in entries(stream, contents(stream)[partition.value]):
                if m := ENTRY.fullmatch(name):
                    yield LEAF_ZOOM, int(m[1]), int(m[2]), crc, data
                elif self.mode == "FAILFAST":
                    raise ValueError(f"not a tile: {name}")


class SevenZipTiles(DataSource):
    """Options: path, mode."""

    @classmethod
    def name(cls) -> str:
        return "tessella_7z"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> SevenZipReader:
        return SevenZipReader(self.options["path"], self.options.get("mode", "PERMISSIVE"))
