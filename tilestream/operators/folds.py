"""Ordered folds over a session's rows: batches, fair queueing, token buckets, smoothed round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, session: str, order: str, values: dict[str, str], start: str, step: str, end: str) -> DataFrame:
    """session and the result of folding its rows in order; a is the state, r the row. A session's rows are one array."""
    row = F.struct(F.col(order).alias("k"), *[F.expr(e).alias(n) for n, e in values.items()])
    return df.groupBy(session).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(session, F.expr(f"aggregate(rows, {start}, (a, r) -> {step}, a -> {end})").alias("out"))


def batches(df: DataFrame, session: str, order: str, size: str, most: int = 16, most_bytes: int = 32768) -> DataFrame:
    """Greedy packing: number of batches of each session, each item taking two bytes more."""
    new = f"(a.n >= {most} OR a.sz + r.len + 2 > {most_bytes})"
    return fold(df, session, order, {"len": size}, "named_struct('b', 0L, 'n', 16L, 'sz', 0L)", f"named_struct('b', a.b + IF({new}, 1L, 0L), 'n', IF({new}, 1L, a.n + 1L), 'sz', IF({new}, r.len + 2L, a.sz + r.len + 2L))", "a.b")


def rounds(df: DataFrame, session: str, order: str, size: str, quantum: int = 32832) -> DataFrame:
    """Deficit round robin: rounds that each session needs."""
    k = f"cast(greatest(0, ceil((r.len - a.deficit) / {quantum})) AS BIGINT)"
    return fold(df, session, order, {"len": size}, "named_struct('round', 0L, 'deficit', 0L)", f"named_struct('round', a.round + {k}, 'deficit', a.deficit + {k} * {quantum} - r.len)", "a.round")


def tokens(df: DataFrame, session: str, order: str, micros: str, cost: str, rate: float, cap: float) -> DataFrame:
    """Token bucket that starts full: items that each session may send."""
    t = f"least({cap}D, a.t + (r.us - a.us) * {rate!r}D)"
    return fold(df, session, order, {"us": micros, "cost": cost}, f"named_struct('t', {cap}D, 'us', cast(NULL AS BIGINT), 'ok', 0L)", f"transform(array(coalesce({t}, {cap}D)), t -> named_struct('t', IF(t >= r.cost, t - r.cost, t), 'us', r.us, 'ok', a.ok + IF(t >= r.cost, 1L, 0L)))[0]", "a.ok")


def smoothed(df: DataFrame, session: str, order: str, sample: str) -> DataFrame:
    """Smoothed value and deviation: weights 7/8 and 3/4, the deviation from the value before the update."""
    step = "IF(a.s < 0, named_struct('s', r.v, 'd', r.v / 2), named_struct('s', 0.875D * a.s + 0.125D * r.v, 'd', 0.75D * a.d + 0.25D * abs(a.s - r.v)))"
    return fold(df, session, order, {"v": sample}, "named_struct('s', -1D, 'd', 0D)", step, "a")
