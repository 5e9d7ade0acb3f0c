"""Ranking, trailing and time windows."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quernstone.operators.hot_keys import ROWS_PER_SLICE, cut_keys, in_slices


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key, numbered in ``rank``.

    The filter on row_number lets Spark keep k rows per key and input split before
    the shuffle, so a hot key arrives already cut down.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def trailing(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie_break: list[str],
    preceding: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``columns`` computed over each row and the ``preceding`` rows before it.

    Rows are ordered by ``ts`` and ``tie_break``, in slices of bounded size; a slice that
    continues a key is preceded by a copy of the last rows before it.
    """
    order = [ts, *tie_break]
    sliced = in_slices(
        df.withColumn("_nth", F.monotonically_increasing_id()),
        keys,
        [F.col(c) for c in [*order, "_nth"]],
        rows_per_slice,
    )
    row = F.struct(*order, "_nth", *[c for c in df.columns if c not in order])
    latest = Window.partitionBy(*keys, "_slice").orderBy(
        *[F.col(c).desc() for c in [*order, "_nth"]]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-preceding, -1)
    # every slice present has a row, so `preceding` slices hold enough of them
    tails = (
        cut_keys(sliced, keys)
        .withColumn("_back", F.row_number().over(latest))
        .filter(F.col("_back") <= preceding)
        .groupBy(*keys, "_slice")
        .agg(F.sort_array(F.collect_list(row)).alias("_tail"))
        .withColumn("_tail", F.flatten(F.collect_list("_tail").over(earlier)))
    )
    start = F.greatest(F.lit(1), F.size("_tail") - preceding + 1)
    copies = (
        tails.select("_slice", F.explode(F.slice("_tail", start, preceding)).alias("_row"))
        .select("_row.*", "_slice")
        .withColumn("_copy", F.lit(True))
    )
    rows = sliced.withColumn("_copy", F.lit(False)).unionByName(copies)
    frame = (
        Window.partitionBy(*keys, "_slice").orderBy(*order, "_nth").rowsBetween(-preceding, 0)
    )
    return (
        rows.withColumns({name: make(frame) for name, make in columns.items()})
        .filter(~F.col("_copy"))
        .drop("_slice", "_copy", "_nth")
    )


def tumbling(df: DataFrame, ts: str, width: str, sums: dict[str, Column]) -> DataFrame:
    """Counts and sums per ``width``, for batch and streaming input."""
    return (
        df.groupBy(F.window(ts, width).alias("_w"))
        .agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
        .select(F.col("_w.start").alias("window_start"), "n", *sums)
    )


def _seconds(interval: str) -> int:
    """Whole seconds of an interval such as ``"90 minutes"`` or ``"1 hour 30 minutes"``."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
    parts = interval.lower().split()
    if parts[:1] == ["interval"]:
        parts = parts[1:]
    try:
        pairs = zip(parts[::2], parts[1::2], strict=True)
        return sum(int(n) * units[unit.removesuffix("s")] for n, unit in pairs)
    except (KeyError, ValueError):
        raise ValueError(f"not a whole number of seconds to weeks: {interval!r}") from None


def sliding(df: DataFrame, ts: str, width: str, step: str, sums: dict[str, Column]) -> DataFrame:
    """Overlapping windows of ``width``, one every ``step``.

    Rows are counted once per pane, as long as the greatest common divisor of the two;
    only those few counts are copied into the windows that overlap them.
    """
    pane = gcd(_seconds(width), _seconds(step))
    panes = tumbling(df, ts, f"{pane} seconds", sums)
    return (
        panes.groupBy(F.window("window_start", width, step).alias("_w"))
        .agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in sums])
        .select(F.col("_w.start").alias("window_start"), "n", *sums)
    )
