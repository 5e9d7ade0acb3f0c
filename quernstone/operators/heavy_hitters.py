"""Values that make up a given share of all rows, exactly, in bounded memory.

Every task keeps a Misra-Gries summary: a bounded number of counters; when there are more, the
largest count without a counter is taken from all, and noted as missed. A value that is frequent
enough has a counter in some task, and its counters plus all that was missed are at least its
count. What that leaves is few enough to hand to every task, and is counted again exactly.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quernstone.session import scratch


def _with_batch(summary: pa.Table | None, values: pa.Array, counters: int) -> tuple[pa.Table, int]:
    """The summary with a batch's values counted in, and what each counter lost."""
    added = pa.table({"value": values, "n": pa.array([1] * len(values), pa.int64())})
    both = added if summary is None else pa.concat_tables([summary, added])
    both = both.group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"])
    if both.num_rows <= counters:
        return both, 0
    cut = pc.take(both["n"], pc.sort_indices(both["n"], sort_keys=[("", "descending")]))[counters]
    left = both.set_column(1, "n", pc.subtract(both["n"], cut))
    return left.filter(pc.greater(left["n"], 0)), cut.as_py()


def summaries(df: DataFrame, column: str, counters: int) -> DataFrame:
    """``value, counted, missed, rows``: the counters of every task, and one row with its sums.

    A task's ``missed`` is at most its rows over ``counters + 1``, and no value that it holds
    occurs in it more often than ``counted`` (0 without a counter) plus ``missed``.
    """
    numbers = [StructField(n, LongType()) for n in ("counted", "missed", "rows")]
    schema = StructType([StructField("value", df.select(column).schema[0].dataType), *numbers])

    def summarize(batches):
        summary, missed, rows = None, 0, 0
        for batch in batches:
            summary, cut = _with_batch(summary, batch.column(0), counters)
            missed, rows = missed + cut, rows + batch.num_rows
        if summary is None:
            return
        values, n = summary["value"].combine_chunks(), summary["n"].combine_chunks()
        zeros = pa.array([0] * len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([values, n, zeros, zeros], names=schema.names)
        sums = [pa.array([v], pa.int64()) for v in (0, missed, rows)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, values.type), *sums], names=schema.names)

    return df.select(F.col(column).alias("value")).mapInArrow(summarize, schema)


def heavy_hitters(df: DataFrame, column: str, one_in: int) -> DataFrame:
    """``column, n`` of the values that at least one row in ``one_in`` has.

    NULL counts as a value. The column is a string, a number without fraction, a date or a
    time. ``df`` is computed twice and must give the same rows. The recount broadcasts at most
    2 * ``one_in`` values: what a task misses is at most its rows over 2 * ``one_in`` + 1, so that
    the counters of a candidate hold more than half of what makes a value frequent.
    """
    spark = df.sparkSession
    path = scratch(spark, "summaries")
    found = summaries(df, column, 2 * one_in)
    found.write.parquet(path)
    stored = spark.read.schema(found.schema).parquet(path)
    missed, rows = stored.agg(F.sum("missed"), F.sum("rows")).first()
    missed, rows = missed or 0, rows or 0
    candidates = (
        stored.groupBy("value")
        .agg(F.sum("counted").alias("counted"))
        .where((F.col("counted") > 0) & ((F.col("counted") + missed) * one_in >= rows))
        .select("value")
    )
    again = df.select(F.col(column).alias("_value"))
    same = F.col("_value").eqNullSafe(F.col("value"))
    return (
        again.join(F.broadcast(candidates), same, "left_semi")
        .groupBy(F.col("_value").alias(column))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") * one_in >= rows)
    )
