"""Telemetry of reliable streams: duplicates dropped within the watermark, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivered(stream: DataFrame, session: str, seq: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each segment of a session once."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([session, seq])


def rates(stream: DataFrame, session: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Segments of each session and window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), session).agg(F.count("*").alias("segments"))
