"""Drop repeated events from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """One row per key, as long as copies are at most ``delay`` apart in ``ts``.

    Nothing thins the rows before the watermark: of a late and a timely copy the
    late one must not win, and dropped copies must still move the watermark on.
    """
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
