"""Watermarked window aggregates. Input: a stream whose ``ts`` is a zoned timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.windows import tumbling


def stream_tumbling(
    df: DataFrame, ts: str, width: str, delay: str, sums: dict[str, Column]
) -> DataFrame:
    """Windows are emitted once, when the watermark (latest ts - ``delay``) has passed them."""
    return tumbling(df.withWatermark(ts, delay), ts, width, sums)


def stream_sessions(df: DataFrame, keys: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions are emitted once the watermark has passed their last event + ``gap``."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(F.max(ts).alias("session_end"), F.count("*").alias("n_events"))
        .select(*keys, F.col("_w.start").alias("session_start"), "session_end", "n_events")
    )
