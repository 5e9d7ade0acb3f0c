"""Run a stream over everything available, then hand its output on as a batch table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import scratch, settings

# Keyed state goes to disk instead of the executor heap, and a batch uploads its
# changes rather than snapshots. Sessions are merged within a partition before the
# shuffle, so a hot key travels as few rows.
_STREAM_SETTINGS = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution."
    "streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
    "spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition": "true",
}


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Write final rows to Parquet. The file sink's log makes a retried batch harmless."""
    base = scratch(df.sparkSession, label)
    _append(df, base)
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def run_to_end(
    events: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], label: str
) -> DataFrame:
    """All rows of ``build(events)`` in append mode, also of windows open at the end.

    A second source, empty at first, is part of the stream. When all events are
    read, it gets one row without values in the far future, and the stream goes on
    from its checkpoint: the watermark passes every window but that row's own, which stays
    open and so never reaches the result. The checkpoint is for this bounded run
    only; events added later would all be late.
    """
    spark = events.sparkSession
    base = scratch(spark, label)
    spark.createDataFrame([], events.schema).write.parquet(f"{base}/last")
    last = spark.readStream.schema(events.schema).parquet(f"{base}/last")
    df = build(events.unionByName(last))
    _append(df, base)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != ts]
    future = F.lit("9000-01-01").cast("timestamp").alias(ts)
    row = spark.range(1).select(future, *nothing).select(*events.columns)
    row.write.mode("append").parquet(f"{base}/last")
    _append(df, base)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _append(df: DataFrame, base: str) -> None:
    spark = df.sparkSession
    with settings(spark, **_STREAM_SETTINGS):
        query = (
            df.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def run_update(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """The latest row per key of a stream in update mode.

    Each batch overwrites a folder of its own, so a retried batch replaces its
    first attempt.
    """
    spark = df.sparkSession
    base = scratch(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    with settings(spark, **_STREAM_SETTINGS):
        query = (
            df.writeStream.foreachBatch(write)
            .outputMode("update")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    return (
        spark.read.schema(df.schema.add("batch", "long"))
        .parquet(f"{base}/out")
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
        .select(*keys, "_last.*")
    )
