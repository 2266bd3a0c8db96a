"""Windowed aggregates that hold for batches and, with a watermark, for streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def with_event_time(df: DataFrame, column: str, delay: str | None) -> DataFrame:
    """The event time as a timestamp (watermarks refuse zoneless ones; use a UTC session), and the watermark of a stream."""
    rows = df.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, delay) if delay and df.isStreaming else rows


def _summed(df: DataFrame, over: Column, keys: Sequence[str], value: str | None) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("n"), *([F.round(F.sum(value), 4).alias("total")] if value else [])]
    grouped = df.groupBy(over.alias("w"), *keys).agg(*sums)
    zoneless = lambda c: F.col(c).cast("timestamp_ntz")
    return grouped.select(zoneless("w.start").alias("start"), zoneless("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def tumbling(df: DataFrame, time: str, width: str, keys: Sequence[str] = (), value: str | None = None, delay: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window of fixed width (sliding with ``slide``)."""
    rows = with_event_time(df, time, delay)
    return _summed(rows, F.window(time, width, slide) if slide else F.window(time, width), keys, value)


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str] = (), value: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Counts and sums by session: rows of a key with gaps under ``gap``."""
    return _summed(with_event_time(df, time, delay), F.session_window(time, gap), keys, value)
