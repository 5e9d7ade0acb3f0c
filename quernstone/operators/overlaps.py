"""Pairs of intervals that overlap, whatever their lengths.

Cutting time into equal cells either copies a long interval into very many cells or
lets short ones meet in cells far too wide. Here every interval lies at the level of its
own length, where cells double from level to level, and in at most two cells of
that level. Two intervals overlap exactly if one of the two starts inside the
other, so only points are looked up: a start goes to its one cell of every level that
occurs. A pair is met at one level, in one cell, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import micros

#: Every so many doublings make a level: fewer copies of the points, wider cells.
_STEP = 2


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
) -> DataFrame:
    """Every pair of equal ``by`` whose closed intervals share an instant; all columns of both.

    A row without a key, a start or an end, or that ends before it starts, meets nothing. Other
    columns need different names on the two sides. The rows that are shuffled are
    twice the intervals, and the points times the levels that occur (at most 32): one year-long
    interval adds one level, it does not multiply the short ones.
    """
    shared = (set(left.columns) & set(right.columns)) - set(by)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    left, right = (
        side.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, *span]))
        .where(F.col(span[1]) >= F.col(span[0]))
        for side, span in ((left, left_span), (right, right_span))
    )
    columns = [*left.columns, *[c for c in right.columns if c not in by]]
    # the left one starts within the right one, or the right one later, within the left one
    starts = micros(left_span[0]) >= micros(right_span[0])
    inside = _stabbed(left, left_span[0], right, right_span, by, starts)
    later = _stabbed(right, right_span[0], left, left_span, by, ~starts)
    return inside.select(*columns).unionAll(later.select(*columns))


def _level(span: tuple[str, str]) -> Column:
    """The lowest level whose cells are as long as the interval."""
    bits = F.length(F.bin(micros(span[1]) - micros(span[0])))
    return (F.ceil(bits / _STEP) * _STEP).cast("int")


def _stabbed(
    points: DataFrame, at: str, intervals: DataFrame, span: tuple[str, str], by: list[str],
    order: Column,
) -> DataFrame:
    """Points with the intervals that hold them, of those pairs that ``order`` allows."""
    levelled = intervals.withColumn("_level", _level(span))
    levels = levelled.agg(F.sort_array(F.collect_set("_level"))).first()[0]
    cells = [F.call_function("shiftright", micros(c), F.col("_level")) for c in span]
    cut = levelled.withColumn("_cell", F.explode(F.array_distinct(F.array(*cells))))
    if not levels:
        levels = [0]
    lookups = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn(
        "_cell", F.call_function("shiftright", micros(at), F.col("_level"))
    )
    # exact at the cells' edges
    held = (micros(at) >= micros(span[0])) & (micros(at) <= micros(span[1]))
    return lookups.join(cut, [*by, "_level", "_cell"]).where(held & order)
