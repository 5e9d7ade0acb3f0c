"""How many different members were active in the days up to each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trailing_distinct(
    df: DataFrame, day: Column, member: str, widths: dict[str, int], keys: list[str] | None = None
) -> DataFrame:
    """One row per ``keys`` and day from the first to the last: different members of the last days.

    ``widths``: column name -> number of days, that day included. A member's active day
    counts until it leaves the window or the member's next active day takes over: a
    difference of +1 and one of -1, which a running sum over the days turns into the
    counts. No pairs of days are formed, and no member is counted per window. Days
    without rows have rows too; rows without a day play no part, NULL members are not
    counted. A hot member has one row per day before the window sees it.
    """
    keys = keys or []
    dated = df.withColumn("_day", day.cast("date")).where("_day IS NOT NULL")
    active = dated.where(F.col(member).isNotNull()).select(*keys, member, "_day").distinct()
    following = F.lead("_day").over(Window.partitionBy(*keys, member).orderBy("_day"))
    changes = active.withColumn("_next", following).select(
        *keys,
        F.explode(
            F.array(
                F.struct("_day", *[F.lit(1).alias(name) for name in widths]),
                *[
                    F.struct(
                        F.least(F.date_add("_day", n), F.col("_next")).alias("_day"),
                        *[F.lit(-1 if other == name else 0).alias(other) for other in widths],
                    )
                    for name, n in widths.items()
                ],
            )
        ).alias("_change"),
    )
    changes = (
        changes.select(*keys, "_change.*").groupBy(*keys, "_day")
        .agg(*[F.sum(name).alias(name) for name in widths])
    )
    calendar = (
        dated.groupBy(*keys).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
        .where("_first IS NOT NULL")
        .select(*keys, F.explode(F.sequence("_first", "_last")).alias("_day"))
    )
    # NULL keys are keys too
    changes = changes.withColumnsRenamed({c: f"_on_{c}" for c in [*keys, "_day"]})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in [*keys, "_day"]]
    running = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = [F.sum(F.coalesce(F.col(name), F.lit(0))).over(running).alias(name) for name in widths]
    return calendar.join(changes, same, "left").select(*keys, F.col("_day").alias("day"), *totals)
