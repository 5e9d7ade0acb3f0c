"""Sketches stored per day and merged later, without going back to the rows.

A sketch row holds the count of its rows, a theta sketch of who was there and a quantile
sketch of their values. Both merge exactly like the rows they stand for, so any range of
days, and any set of keys, can be asked for from the stored table alone. Theta
sketches also give how many are in two sets, or in one and not the other.

The aggregation is partial before the shuffle: a hot key sends one sketch per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members that a theta sketch counts exactly: 2 to this power; beyond, 1.6 % standard error.
LOG_MEMBERS = 12
#: Size of a quantile sketch: ranks within about 1.7 % with 99 % confidence.
VALUES = 200


def sketched(
    df: DataFrame, keys: list[str], member: str, value: str, log_members: int = LOG_MEMBERS,
    values: int = VALUES,
) -> DataFrame:
    """One row per ``keys``: ``n`` rows, ``members`` and ``values`` as sketches.

    NULL members and values are left out of the sketches, not of ``n``. A key without a
    value has an empty sketch.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.theta_sketch_agg(member, log_members).alias("members"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), values).alias("values"),
    )


def merged(sketches: DataFrame, keys: list[str], log_members: int = LOG_MEMBERS) -> DataFrame:
    """The sketches of every ``keys`` as one; the same columns as ``sketched`` gives."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.theta_union_agg("members", log_members).alias("members"),
        F.kll_merge_agg_double("values").alias("values"),
    )


def n_members(members: str | Column) -> Column:
    """How many different members; rounded to a whole number."""
    return F.theta_sketch_estimate(members)


def n_in_both(a: str | Column, b: str | Column) -> Column:
    """How many members two sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def n_values(values: str | Column) -> Column:
    return F.kll_sketch_get_n_double(values)


def quantile(values: str | Column, share: float) -> Column:
    """The value with ``share`` of all values at or below it; NULL of an empty sketch."""
    values = F.col(values) if isinstance(values, str) else values
    return F.when(n_values(values) > 0, F.kll_sketch_get_quantile_double(values, F.lit(share)))
