"""Reversible Haar wavelet over rasters in long form (image, y, x, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _paired(df: DataFrame, image: str, axis: str, other: str, half: int, place: Column, low: Column, made: Callable) -> DataFrame:
    """Replaces pairs within the corner of side 2 half, in one aggregation; cells outside are groups of their own and stay."""
    inside = (F.col(axis) < 2 * half) & (F.col(other) < 2 * half)
    pair = df.groupBy(image, other, inside.alias("inside"), F.when(inside, place).otherwise(F.col(axis)).alias("i")).agg(F.max(F.when(low | ~inside, F.col("v"))).alias("a"), F.max(F.when(~low & inside, F.col("v"))).alias("b"))
    cells = F.when(F.col("inside"), F.array(*(F.struct(p.cast("int").alias("p"), v.alias("v")) for p, v in made()))).otherwise(F.array(F.struct(F.col("i").cast("int").alias("p"), F.col("a").alias("v"))))
    return pair.select(image, other, F.explode(cells).alias("e")).select(image, F.col(other), F.col("e.p").alias(axis), F.col("e.v").alias("v"))


def _step(df: DataFrame, image: str, axis: str, other: str, half: int) -> DataFrame:
    """Pairs along an axis become floor of the mean in the low half and the difference in the high half."""
    d = F.col("b") - F.col("a")
    return _paired(df, image, axis, other, half, F.shiftright(axis, 1), F.col(axis) % 2 == 0, lambda: ((F.col("i"), F.col("a") + F.shiftright(d, 1)), (F.col("i") + half, d)))


def forward(df: DataFrame, image: str, side: int, levels: int) -> DataFrame:
    """Rows, then columns, on the shrinking top left corner."""
    for k in range(levels):
        half = side >> (k + 1)
        df = _step(_step(df, image, "x", "y", half), image, "y", "x", half)
    return df


def _unstep(df: DataFrame, image: str, axis: str, other: str, half: int) -> DataFrame:
    a0 = F.col("a") - F.shiftright("b", 1)
    return _paired(df, image, axis, other, half, F.col(axis) % half, F.col(axis) < half, lambda: ((2 * F.col("i"), a0), (2 * F.col("i") + 1, a0 + F.col("b"))))


def inverse(df: DataFrame, image: str, side: int, levels: int) -> DataFrame:
    """Undoes forward(): columns, then rows, from coarse to fine."""
    for k in range(levels - 1, -1, -1):
        half = side >> (k + 1)
        df = _unstep(_unstep(df, image, "y", "x", half), image, "x", "y", half)
    return df
