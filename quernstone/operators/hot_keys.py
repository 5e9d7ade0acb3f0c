"""Lay rows out in slices of bounded size, whatever their keys.

A window per key puts one key into one task. Here rows are first dealt by range of
(hash of the keys, order within a key), so that every slice has about the same
number of rows: a small key lies in one slice with others, a hot key runs through as
many slices as it needs. The windows then run per key and slice.

There is no threshold and no list of hot keys: every input is laid out the same way.
Results never depend on where the cuts fall; whatever a slice needs from the time
before it is handed over by the operators that use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import scratch

ROWS_PER_SLICE = 1_000_000  # rows one task sorts without trouble


def in_slices(
    rows: DataFrame, keys: list[str], order: list[Column], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``rows`` as a written table with ``_slice``, which rises with ``order`` inside a key.

    Rows equal in keys and ``order`` stay in one slice; add a distinguishing column to
    ``order`` to have such ties cut too. Spark samples the rows to find the cuts, so
    slices hold ``rows_per_slice`` on average and rarely twice that. The table is
    written because every branch of a plan, and every retried task, must see the
    same cuts; the input is computed for the sample, the count and the table.
    """
    spark = rows.sparkSession
    n = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_slice)
    )
    path = scratch(spark, "slices")
    dealt = (
        rows.repartitionByRange(n, F.xxhash64(*keys), *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def cut_keys(sliced: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keys that lie in several slices: the only ones that need a hand-over.

    Neighbouring slices share at most one key, so the list of such keys is no longer
    than the list of slices.
    """
    hashed = sliced.withColumn("_hash", F.xxhash64(*keys))
    cut = (
        hashed.groupBy("_hash")
        .agg(F.min("_slice").alias("_low"), F.max("_slice").alias("_high"))
        .filter("_low < _high")
        .select("_hash")
    )
    return hashed.join(cut, "_hash", "left_semi").drop("_hash")
