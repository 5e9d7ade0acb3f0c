"""Series on a regular grid of time, gaps filled from the neighbours on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import micros
from quernstone.operators.hot_keys import ROWS_PER_SLICE, cut_keys, in_slices


def interpolated(
    rows: DataFrame, keys: list[str], ts: str, value: str, step: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``keys, ts, value, known``: a row for every ``step`` seconds between a key's first and last.

    A step's value is the largest of its rows; a step without one lies on the line between the
    steps with values before and after it, and is not ``known``. Rows without time or
    value count as not there; NULL keys are a key. ``ts`` is the start of the step.

    Steps are put together before anything is laid out, so a key has at most as many rows as there are steps.
    They run through slices of bounded size; a slice that ends inside a key is handed the first
    step of the next one. A gap is filled where it begins, from one row.
    """
    width = step * 1_000_000
    time = micros(ts)
    known = (
        rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
        .groupBy(*keys, (time - F.pmod(time, F.lit(width))).alias("_at"))
        .agg(F.max(value).alias("_value"))
    )
    sliced = in_slices(known, keys, [F.col("_at")], rows_per_slice)
    point = F.struct("_at", "_value")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at")
    firsts = cut_keys(sliced, keys).groupBy(*keys, "_slice").agg(F.min(point).alias("_first"))
    slices = Window.partitionBy(*keys).orderBy("_slice")
    later = firsts.select(
        *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_before"), F.lead("_first").over(slices).alias("_later"),
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)],
        F.col("_slice") == F.col("_before"),
    )
    ahead = (
        sliced.withColumn("_next", F.lead(point).over(inside))
        .join(later, same, "left")
        .withColumn("_next", F.coalesce("_next", "_later"))
        .withColumn("_steps", ((F.col("_next._at") - F.col("_at")) / width).cast("long"))
    )
    filled = ahead.withColumn(
        "_i", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_steps", F.lit(1)) - 1))
    )
    between = (F.col("_next._value") - F.col("_value")) * F.col("_i") / F.col("_steps")
    start = F.timestamp_micros(F.col("_at") + F.col("_i") * width)
    return filled.select(
        *keys,
        start.cast(rows.schema[ts].dataType).alias(ts),
        F.when(F.col("_i") == 0, F.col("_value")).otherwise(F.col("_value") + between).alias(value),
        (F.col("_i") == 0).alias("known"),
    )
