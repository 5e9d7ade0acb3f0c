"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.hot_keys import ROWS_PER_SLICE, in_slices


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    shares: dict[str, float],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Interpolated percentiles of non-NULL ``value``, one column per entry of ``shares``.

    Spark's own ``percentile`` keeps all distinct values of a group in one buffer.
    Here equal values are counted first, and the counts dealt by range of (keys, value)
    into slices of bounded size. The counts of the slices before it tell a slice the
    ranks of its values; whichever slice holds a wanted rank reports it. One plan for any
    number of groups, also for none (``keys`` empty: one row, none without values).
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_copies"))
    by = keys or ["_all"]
    if not keys:
        counted = counted.withColumn("_all", F.lit(0))
    sliced = in_slices(counted, by, [F.col("_v")], rows_per_slice)

    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and slice: no more than groups and slices together
    slices = (
        sliced.groupBy(*by, "_slice")
        .agg(F.sum("_copies").alias("_m"))
        .select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(by)],
            F.col("_slice").alias("_of"),
            F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
            F.sum("_m").over(group).alias("_n"),
        )
    )
    same = F.col("_slice") == F.col("_of")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    upto = (
        Window.partitionBy(*by, "_slice")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        sliced.withColumn("_end", F.sum("_copies").over(upto))
        .join(slices, same)
        .withColumn("_end", F.col("_end") + F.col("_before"))
    )
    first, last = F.col("_end") - F.col("_copies"), F.col("_end") - 1
    picked = []
    for i, share in enumerate(shares.values()):
        rank = (F.col("_n") - 1) * F.lit(float(share))
        for name, wanted in (("below", F.floor(rank)), ("above", F.ceil(rank))):
            hit = F.when(wanted.between(first, last), F.col("_v"))
            picked.append(F.max(hit).alias(f"_{name}{i}"))
        picked.append(F.max(rank - F.floor(rank)).alias(f"_part{i}"))
    found = ranked.groupBy(*by).agg(*picked)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_below{i}")
                + (F.col(f"_above{i}") - F.col(f"_below{i}")) * F.col(f"_part{i}")
            ).alias(name)
            for i, name in enumerate(shares)
        ],
    )
