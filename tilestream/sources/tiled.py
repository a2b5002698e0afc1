"""Images as packets: strips are cut into tiles, and each tile into bit planes of wavelet precincts; any prefix of layers decodes.

The packet table is the container: Parquet with one row a layer, so reading a tile or a level is a pushed filter, not an offset table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestream.functions import bitplane

# Fixed values of the format.
TILE, LEVELS, PRECINCT, SHIFT = 512, 5, 64, 128
STRIPS = "image_id long, y0 int, rows int, width int, height int, channels int, data binary"
PACKETS = "image_id long, tile int, tx int, ty int, valid_w int, valid_h int, comp int, level int, py int, px int, layer int, num_planes int, num_coeffs int, data binary"
TILES = "image_id long, tile int, tx int, ty int, comp int, valid_w int, valid_h int, pixels binary"


def deflate(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


def forward(a: np.ndarray, levels: int) -> np.ndarray:
    """Rows, then columns, on the shrinking corner."""
    a = a.astype(np.int64)
    n = len(a)
    for _ in range(levels):
        for axis in (1, 0):
            c = a[:n, :n] if axis else a[:n, :n].T
            d = c[:, 1::2] - c[:, 0::2]
            c[:, :] = np.concatenate((c[:, 0::2] + (d >> 1), d), 1)
        n //= 2
    return a


def inverse(a: np.ndarray, levels: int) -> np.ndarray:
    a = a.astype(np.int64)
    for k in range(levels - 1, -1, -1):
        n = len(a) >> k
        for axis in (0, 1):
            c = a[:n, :n] if axis else a[:n, :n].T
            s, d = c[:, : n // 2].copy(), c[:, n // 2 :].copy()
            c[:, 0::2] = s - (d >> 1)
            c[:, 1::2] = s - (d >> 1) + d
    return a


def resolution(side: int, levels: int) -> np.ndarray:
    """The level of each place: 0 in the smallest corner, one more whenever the side doubles."""
    m = np.maximum.outer(np.arange(side), np.arange(side)) // (side >> levels)
    return np.ceil(np.log2(m + 1)).astype(int)


def precincts(side: int, levels: int, precinct: int) -> list[tuple[int, int, int, np.ndarray]]:
    """level, py, px and places, in row order, of every precinct of a tile; the grid counts coefficients of the whole tile."""
    level = resolution(side, levels)
    at = np.arange(side) // precinct
    key = (level * 4096 + at[:, None]) * 4096 + at[None, :]
    order = np.argsort(key.ravel(), kind="stable")
    cuts = np.flatnonzero(np.diff(key.ravel()[order])) + 1
    return [(int(k) >> 24, int(k) >> 12 & 4095, int(k) & 4095, places) for places in np.split(order, cuts) for k in [key.ravel()[places[0]]]]


def encode(strips: DataFrame, tile: int = TILE, levels: int = LEVELS, precinct: int = PRECINCT) -> DataFrame:
    """Packets of strips of `tile` rows each. Every strip is a task's own work, so nothing is shuffled; precincts of zeros make no packets."""
    parts = precincts(tile, levels, precinct)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                px = np.frombuffer(s.data, np.uint8).reshape(s.rows, s.width, s.channels)
                across, ty = -(-s.width // tile), s.y0 // tile
                for tx in range(across):
                    part = px[:, tx * tile : (tx + 1) * tile]
                    h, w = part.shape[:2]
                    full = np.pad(part, ((0, tile - h), (0, tile - w), (0, 0)), "edge")
                    out = []
                    for comp in range(s.channels):
                        v = forward(full[:, :, comp].astype(np.int64) - SHIFT, levels).ravel()
                        for level, py, qx, places in parts:
                            own = v[places]
                            n = bitplane.planes(own)
                            out += [(s.image_id, ty * across + tx, tx, ty, w, h, comp, level, py, qx, i, n, len(own), deflate(b)) for i, b in enumerate(bitplane.encode(own, n))]
                    if out:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKETS.split(", ")])

    return strips.mapInPandas(run, PACKETS)


def decode(packets: DataFrame, tile: int = TILE, levels: int = LEVELS, precinct: int = PRECINCT, layers: int | None = None) -> DataFrame:
    """Pixels of each tile and component from at most so many layers of each precinct. A group is one tile's packets, which its side bounds."""
    parts = {p[:3]: p[3] for p in precincts(tile, levels, precinct)}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(tile * tile, np.int64)
        for place, own in pdf.groupby(["level", "py", "px"]):
            n, count = int(own["num_planes"].iloc[0]), int(own["num_coeffs"].iloc[0])
            have = dict(zip(own["layer"], own["data"], strict=True))
            v[parts[tuple(int(p) for p in place)]] = bitplane.decode([inflate(have[i]) if i in have else None for i in range(n)], count, n)
        first = pdf.iloc[0]
        px = (inverse(v.reshape(tile, tile), levels) + SHIFT).clip(0, 255).astype(np.uint8)
        return pd.DataFrame([(*key[:2], first["tx"], first["ty"], key[2], first["valid_w"], first["valid_h"], px[: first["valid_h"], : first["valid_w"]].tobytes())], columns=[c.split()[0] for c in TILES.split(", ")])

    kept = packets if layers is None else packets.where(F.col("layer") < layers)
    return kept.groupBy("image_id", "tile", "comp").applyInPandas(run, TILES)


def png_strips(files: DataFrame, rows: int = TILE) -> DataFrame:
    """Strips of the PNG images of a binaryFile table. One image is one zlib stream, so one task; it holds one strip's pixels."""
    from tilestream.sources import png

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, content in zip(pdf["image_id"], pdf["content"], strict=True):
                for y0, height, px in png.strips(content, rows):
                    yield pd.DataFrame([(image, y0, px.shape[0], px.shape[1], height, px.shape[2], px.tobytes())], columns=[c.split()[0] for c in STRIPS.split(", ")])

    return files.select(F.xxhash64("path").alias("image_id"), "content").mapInPandas(run, STRIPS)
