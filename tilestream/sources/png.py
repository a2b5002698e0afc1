"""PNG images to rows and back: 8 bits, not interlaced; alpha is dropped. One image is one zlib stream, so one task reads it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG of an array (height, width, 1 or 3)."""
    h, w, c = pixels.shape
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c).astype(np.uint8)), 1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 1 or 3) of a PNG."""
    return np.concatenate([px for _, _, px in strips(data, 512)])


def strips(data: bytes, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, the image's height and the pixels of each strip. Chunks are inflated one by one; only a strip's pixels are held."""
    head, body = _chunks(data)
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("only 8-bit images without interlacing")
    c = CHANNELS[colour]
    width, buffer, inflater = 1 + w * c, b"", zlib.decompressobj()
    up, got, y = np.zeros(w * c, np.int64), [], 0
    for part in body:
        while part and y < h:
            buffer += inflater.decompress(part, width * rows)
            part = inflater.unconsumed_tail
            whole = min(len(buffer) // width, h - y)
            for raw in np.frombuffer(buffer, np.uint8, whole * width).reshape(whole, width):
                up = _unfilter(int(raw[0]), raw[1:].astype(np.int64), up, c)
                got.append(up.astype(np.uint8))
                y += 1
                if len(got) == rows or y == h:
                    yield y - len(got), h, np.stack(got).reshape(len(got), w, c)[:, :, : 1 if c < 3 else 3]
                    got = []
            buffer = buffer[whole * width :]
    if y < h:
        raise ValueError("the image ends early")


def _chunks(data: bytes) -> tuple[bytes, Iterator[bytes]]:
    """The header and the bodies of the IDAT chunks."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")

    def walk() -> Iterator[tuple[bytes, bytes]]:
        at = 8
        while at + 8 <= len(data):
            (size,) = struct.unpack_from(">I", data, at)
            yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
            at += size + 12

    head = next(body for kind, body in walk() if kind == b"IHDR")
    return head, (body for kind, body in walk() if kind == b"IDAT")


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + up) % 256
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), 0).reshape(-1) % 256
    line = line.copy()
    for i in range(len(line)):
        left = line[i - c] if i >= c else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - c] if i >= c else 0
            p = left + up[i] - corner
            near = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))
            guess = near[2]
        line[i] = (line[i] + guess) % 256
    return line
