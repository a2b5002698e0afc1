"""Deep Zoom pyramids in ZIP archives: the directory as a table, checked as a whole; tiles are read by entry, in any task.

Paths must be readable by every executor. One archive's directory is read by one task; tiles are then spread over all of them.
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tilestream.sources import png

# Fixed values of the format.
MOST_DESCRIPTOR, MOST_TILE, MOST_LEVELS = 4096, 1024, 31
NAME = re.compile(r"(?:^|/)(\d+)/(\d+)_(\d+)\.png$")
DIRECTORY = "path string, level int, tx int, ty int, id long, width int, height int, bytes long, entry string"
TILES = DIRECTORY + ", png binary"


def attribute(descriptor: str, name: str) -> str:
    found = re.search(rf'\b{name}\s*=\s*"([^"]*)"', descriptor)
    if not found:
        raise ValueError(f"the descriptor has no {name}")
    return found[1]


def geometry(width: int, height: int, tile: int) -> list[tuple[int, int, int, int, int]]:
    """Width, height, tiles across, tiles down and first id of each level, from one pixel up to the whole image."""
    top = (max(width, height) - 1).bit_length()
    if top >= MOST_LEVELS:
        raise ValueError("too many levels")
    out, first = [], 0
    for level in range(top + 1):
        w, h = -(-width // (1 << (top - level))), -(-height // (1 << (top - level)))
        across, down = -(-w // tile), -(-h // tile)
        out.append((w, h, across, down, first))
        first += across * down
    return out


def listed(path: str) -> list[tuple]:
    """The directory's rows of one archive; ValueError where it isn't a whole pyramid."""
    with zipfile.ZipFile(path) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        descriptors = [i for i in infos if i.filename.endswith(".dzi")]
        if len(descriptors) != 1 or descriptors[0].file_size > MOST_DESCRIPTOR:
            raise ValueError("one small .dzi is needed")
        text = z.read(descriptors[0]).decode("utf-8")
    tile = int(attribute(text, "TileSize"))
    if attribute(text, "Format").lower() != "png" or int(attribute(text, "Overlap")) or not 0 < tile <= MOST_TILE:
        raise ValueError("only PNG tiles of at most 1024 without overlap")
    levels = geometry(int(attribute(text, "Width")), int(attribute(text, "Height")), tile)
    rows: dict[int, tuple] = {}
    for i in infos:
        m = NAME.search(i.filename)
        if not m:
            continue
        level, tx, ty = int(m[1]), int(m[2]), int(m[3])
        if level >= len(levels):
            raise ValueError(f"no such level: {i.filename}")
        w, h, across, down, first = levels[level]
        if tx >= across or ty >= down:
            raise ValueError(f"outside the grid: {i.filename}")
        at = first + ty * across + tx
        if at in rows:
            raise ValueError(f"twice: {i.filename}")
        rows[at] = (path, level, tx, ty, at, min(tile, w - tx * tile), min(tile, h - ty * tile), i.file_size, i.filename)
    if len(rows) != levels[-1][4] + levels[-1][2] * levels[-1][3]:
        raise ValueError("tiles are missing")
    return [rows[k] for k in sorted(rows)]


def directory(paths: DataFrame) -> DataFrame:
    """Rows of the archives in column path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows = listed(path)
                for a in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[a : a + 10_000], columns=[c.split()[0] for c in DIRECTORY.split(", ")])

    return paths.select("path").mapInPandas(run, DIRECTORY)


def tiles(listing: DataFrame) -> DataFrame:
    """The PNG of each row, whose signature and size must be what the directory expects. Filter the listing first: only its rows are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=False):
                with zipfile.ZipFile(path) as z:
                    for a in range(0, len(own), 64):
                        part = own.iloc[a : a + 64].copy()
                        part["png"] = [z.read(e) for e in part["entry"]]
                        for r in part.itertuples(index=False):
                            if r.png[:8] != png.SIGNATURE or struct.unpack(">II", r.png[16:24]) != (r.width, r.height):
                                raise ValueError(f"not the tile expected: {r.entry}")
                        yield part

    return listing.repartition("path", "id").mapInPandas(run, TILES)
