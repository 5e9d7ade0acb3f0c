"""Column expressions shared by the jobs. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(column: str | Column) -> Column:
    """Whole hundredths of an amount, as long. An amount with more decimals is an error.

    A double counts as having two decimals if it is the double nearest to such a number.
    """
    column = F.col(column) if isinstance(column, str) else column
    amount = column.cast("double")
    whole = F.rint(amount * 100)
    refused = F.raise_error(F.concat(F.lit("more than two decimals: "), column.cast("string")))
    exact = (whole / 100 == amount) & (F.abs(whole) < float(2**53))
    return F.when(exact, whole.cast("long")).when(amount.isNotNull(), refused.cast("long"))


_LOW = 1 << 20


def exact_sum(column: Column) -> Column:
    """Aggregate: the sum of a long column as DECIMAL(38,0), NULL without values.

    The upper and the lower bits are summed apart, in longs: exact in any order,
    without decimal objects per row, and far beyond the range of one long. If a
    part overflows nevertheless, the query fails.
    """
    high = F.try_sum(F.shiftright(column, 20))
    low = F.try_sum(column.bitwiseAND(F.lit(_LOW - 1).cast("long")))
    whole = high.cast("decimal(38,0)") * F.lit(_LOW).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    overflow = F.raise_error(F.lit("sum beyond 64 bits and 20")).cast("decimal(38,0)")
    return F.when(F.count(column) > 0, F.coalesce(whole.cast("decimal(38,0)"), overflow))


def shifted(whole: str | Column, places: int, rounded: int | None = None) -> Column:
    """A whole total with its last ``places`` (at most 6) digits behind the point, as nearest double."""
    whole = F.col(whole) if isinstance(whole, str) else whole
    value = whole.cast(f"decimal({38 - places},0)") / F.lit(10**places).cast("decimal(10,0)")
    return (value if rounded is None else F.round(value, rounded)).cast("double")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970. Zoneless values count as UTC, the session zone of all jobs."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def floor_micros(ts: str | Column, width: int) -> Column:
    """Start of the ``width``-microsecond cell that holds ``ts``, also before 1970."""
    value = micros(ts)
    return value - F.pmod(value, F.lit(width))
