"""Running totals per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import hundredths


def running_totals(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Per key the number of rows so far and their total in cents, for update mode.

    Built-in aggregation state: rows are summed per key and input partition before
    the shuffle, and no Python runs per key. Totals are whole numbers; an amount with more
    than two decimals, or a total beyond 64 bits, fails the query.
    """
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(hundredths(amount)), F.lit(0)).alias("cents"),
    )
