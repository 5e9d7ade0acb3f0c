"""Partitioned Parquet sink."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_partitioned(df: DataFrame, path: str, columns: list[str]) -> None:
    """Replace only the partitions present in ``df`` and leave the others alone.

    The rebalance hint gathers each partition value into few files, and adaptive
    execution cuts a value that holds a large share of the rows into several
    tasks of the advisory size.
    """
    (
        df.hint("rebalance", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )
