"""Sessions separated by idle gaps, and ordered funnels inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import floor_micros, micros
from quernstone.operators.hot_keys import ROWS_PER_SLICE, in_slices


def _number_sessions(pieces: DataFrame, keys: list[str], gap_micros: int) -> DataFrame:
    """Add ``_session``; pieces are (_first, _last) spans that do not overlap in time."""
    in_order = Window.partitionBy(*keys).orderBy("_first")
    idle = micros("_first") - micros(F.lag("_last").over(in_order))
    starts = F.when(idle > gap_micros, 1).otherwise(0)
    return pieces.withColumn("_starts", starts).withColumn(
        "_session",
        F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
    )


def sessionize(
    df: DataFrame,
    keys: list[str],
    ts: str,
    gap_seconds: int,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per session: keys, session_start, session_end, n_events and ``sums``.

    A session ends where the next event of the key comes more than ``gap_seconds``
    later, as with Spark's ``session_window``, which the streaming version uses.
    Two events in one gap-wide time cell always share a session, so events
    are first counted per (key, cell), with map-side combine. Only cells meet in a
    per-key window: at most time range / gap rows, however many events a key has.
    """
    sums = sums or {}
    gap = gap_seconds * 1_000_000
    cells = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, floor_micros(ts, gap).alias("_cell"))
        .agg(
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.count("*").alias("_n"),
            *[F.sum(column).alias(name) for name, column in sums.items()],
        )
    )
    return (
        _number_sessions(cells, keys, gap)
        .groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("session_end"),
            F.sum("_n").alias("n_events"),
            *[F.sum(name).alias(name) for name in sums],
        )
        .drop("_session")
    )


def funnel(
    df: DataFrame,
    keys: list[str],
    ts: str,
    step: str,
    steps: list[str],
    gap_seconds: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per session with ``steps_reached``: how many ``steps`` happen in order.

    Step i counts if it comes strictly after the first match of step i - 1. Events
    are scanned in pieces (key, gap-wide cell, slice). A piece says,
    for every number of steps already done, how many are done after it; such
    tables compose, so a session folds its few pieces instead of its events.
    """
    n = len(steps)
    gap = gap_seconds * 1_000_000
    events = df.filter(F.col(ts).isNotNull()).select(
        *keys, F.col(ts).alias("_t"), F.col(step).alias("_step")
    )
    # cut by time alone: steps at one time must be seen together
    piece = [*keys, "_cell", "_slice"]
    events = in_slices(events, keys, [F.col("_t")], rows_per_slice).withColumn(
        "_cell", floor_micros("_t", gap)
    )
    # _m{a}_{b}: time at which step b is matched in this piece if a steps are done before it
    whole = Window.partitionBy(*piece)
    for length in range(1, n):
        events = events.withColumns(
            {
                f"_m{a}_{a + length}": F.min(
                    F.when(_matches(steps, a, a + length), F.col("_t"))
                ).over(whole)
                for a in range(n - length + 1)
            }
        )
    pieces = events.groupBy(*piece).agg(
        F.min("_t").alias("_first"),
        F.max("_t").alias("_last"),
        F.count("*").alias("_n"),
        F.min(F.when(_matches(steps, 0, n), F.col("_t"))).alias(f"_m0_{n}"),
        *[
            F.min(f"_m{a}_{b}").alias(f"_m{a}_{b}")
            for a in range(n)
            for b in range(a + 1, n + 1)
            if (a, b) != (0, n)
        ],
    )
    after = [
        F.lit(a) + sum(F.col(f"_m{a}_{b}").isNotNull().cast("int") for b in range(a + 1, n + 1))
        for a in range(n)
    ]
    pieces = pieces.withColumn("_after", F.array(*after, F.lit(n)))
    return (
        _number_sessions(pieces, keys, gap)
        .groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("session_end"),
            F.sum("_n").alias("n_events"),
            F.aggregate(
                F.array_sort(F.collect_list(F.struct("_first", "_after"))),
                F.lit(0),
                lambda done, p: F.get(p["_after"], done),
            ).alias("steps_reached"),
        )
        .drop("_session")
    )


def _matches(steps: list[str], done: int, now: int) -> Column:
    """An event that is step ``now``, later than step ``now - 1`` if that is in this piece too."""
    test = F.col("_step") == steps[now - 1]
    if now - 1 > done:
        test = test & (F.col("_t") > F.col(f"_m{done}_{now - 1}"))
    return test
