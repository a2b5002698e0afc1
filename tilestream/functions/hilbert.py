"""Hilbert curve as column expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def xy2d(x, y, bits: int) -> Column:
    """Distance along the curve of a cell of the grid of side 2**bits."""
    state = F.struct(_long(x).alias("x"), _long(y).alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])

    def step(a: Column, s: Column) -> Column:
        rx, ry = F.when(a["x"] >= s, 1).otherwise(0), F.when(a["y"] >= s, 1).otherwise(0)
        x, y = a["x"] - rx * s, a["y"] - ry * s
        quadrant = F.when(rx == 1, F.when(ry == 1, 2).otherwise(3)).otherwise(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - x).otherwise(x), F.when(flip, s - 1 - y).otherwise(y)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (a["d"] + s * s * quadrant).alias("d"))

    return F.aggregate(sides, state, step, lambda a: a["d"])


def d2xy(d, bits: int) -> Column:
    """struct(x, y) of a distance along the curve."""
    state = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), _long(d).alias("t"))
    sides = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])

    def step(a: Column, s: Column) -> Column:
        rx = F.floor(a["t"] / 2) % 2
        ry = (a["t"] + rx) % 2
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - a["x"]).otherwise(a["x"]), F.when(flip, s - 1 - a["y"]).otherwise(a["y"])
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((x + s * rx).cast("long").alias("x"), (y + s * ry).cast("long").alias("y"), F.floor(a["t"] / 4).cast("long").alias("t"))

    return F.aggregate(sides, state, step, lambda a: F.struct(a["x"], a["y"]))
