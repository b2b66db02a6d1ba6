"""PNG bytes to numpy arrays and back, with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessella.model import rgb

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The passes of an interlaced image, as first column, first row, step of columns, step of rows.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
PALETTE_RGB = np.array([rgb(i) for i in range(64)], np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(indices: np.ndarray) -> bytes:
    """Palette indices (height x width) to an 8-bit paletted PNG; index 0 is transparent."""
    height, width = indices.shape
    raw = np.zeros((height, width + 1), np.uint8)
    raw[:, 1:] = indices
    head = struct.pack(">IIBBBBB", width, height, 8, 3, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", PALETTE_RGB.tobytes()) + _chunk(b"tRNS", b"\0" + b"\xff" * 63) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows with a filter byte in front to plain rows; step: bytes of a pixel (1 at least)."""
    kinds, height, size = raw[:, 0], raw.shape[0], raw.shape[1] - 1
    if (kinds > 4).any():
        raise ValueError(f"filter {kinds.max()}")
    if (kinds > 2).any():
        return _by_diagonals(raw[:, 1:].reshape(height, -1, step), kinds).reshape(height, size)
    out = np.zeros((height, size), np.uint8)
    above = np.zeros(size, np.uint8)
    for y in range(height):
        now = raw[y, 1:]
        if kinds[y] == 1:
            now = np.cumsum(now.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kinds[y] == 2:
            now = now + above
        out[y] = above = now
    return out


def _by_diagonals(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Pixels [y, x, byte] with any filters: those of one x + y need only pixels of the two diagonals before."""
    height, width, step = raw.shape
    out = np.zeros_like(raw)
    # By row, below a row of noughts: the pixel on the last diagonal and on the one before it.
    last, before = (np.zeros((height + 1, step), np.int16) for _ in range(2))
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        left, up, corner, kind = last[y + 1], last[y], before[y], kinds[y, None]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        before, last = last, np.zeros_like(last)
        last[y + 1] = out[y, d - y] = raw[y, d - y] + guess & 255
    return out


def _samples(raw: np.ndarray, width: int, height: int, n: int, depth: int, scaled: bool) -> np.ndarray:
    """Filtered rows to samples [y, x, channel] of 8 bits; scaled: those of fewer bits are spread over all 8."""
    flat = _unfilter(raw.reshape(height, -1), max(1, n * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = (bits @ (1 << np.arange(depth)[::-1]))[:, : width * n].astype(np.uint8)
        flat = (flat.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8) if scaled else flat
    return flat.reshape(height, width, n)


def _chunks(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(the first chunk of each kind, the joined image data)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, found, body = 8, {}, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        body.append(part) if kind == b"IDAT" else found.setdefault(kind, part)
        at += size + 12
        if kind == b"IEND":
            break
    return found, b"".join(body)


def decode_paletted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, palette as RGBA) of a paletted PNG; any other one fails."""
    pixels, table = decode(data)
    if table is None:
        raise ValueError("not paletted")
    return pixels, table


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(indices, palette as RGBA) of a paletted PNG, else (pixels as RGBA of 8 bits, None)."""
    found, body = _chunks(data)
    width, height, depth, mode, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if interlaced > 1:
        raise ValueError(f"interlace method {interlaced}")
    n = CHANNELS[mode]
    raw, at = np.frombuffer(zlib.decompress(body), np.uint8), 0
    pixels = np.zeros((height, width, n), np.uint8)
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -((x - width) // dx), -((y - height) // dy)
        if w > 0 and h > 0:
            end = at + h * (1 + (w * n * depth + 7) // 8)
            pixels[y::dy, x::dx] = _samples(raw[at:end], w, h, n, depth, mode != 3)
            at = end
    if at != len(raw):
        raise ValueError(f"{len(raw)} bytes of pixels, not {at}")
    clear = found.get(b"tRNS")
    if mode == 3:
        table = np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(table)]
        return pixels[:, :, 0], np.concatenate([table, alpha[:, None]], axis=1)
    color = np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3]
    alpha = pixels[:, :, -1:] if n in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    if clear and n in (1, 3):
        key = np.frombuffer(clear, ">u2")
        key = key >> 8 if depth == 16 else key * 255 // ((1 << depth) - 1) if depth < 8 else key
        alpha = np.where((pixels == key.astype(np.uint8)).all(axis=2, keepdims=True), 0, alpha).astype(np.uint8)
    return np.concatenate([color, alpha], axis=2), None


def quantised(data: bytes) -> np.ndarray:
    """Palette indices of any PNG: alpha-premultiplied channels are looked up; no match is 0."""
    pixels, table = decode(data)
    return _lookup(table)[pixels] if table is not None else _lookup(pixels.reshape(-1, 4)).reshape(pixels.shape[:2])


def _lookup(rgba: np.ndarray) -> np.ndarray:
    wide = rgba.astype(np.int64)
    own = (wide[:, :3] * 257 * wide[:, 3:] // 255) >> 8
    key = own[:, 0] << 16 | own[:, 1] << 8 | own[:, 2]
    keys = PALETTE_RGB.astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
    order = 1 + np.argsort(keys[1:])
    at = np.minimum(np.searchsorted(keys[order], key), 62)
    return np.where((keys[order][at] == key) & (wide[:, 3] > 0), order[at], 0).astype(np.uint8)
