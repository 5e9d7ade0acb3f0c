"""A table of the latest row per key, fed by a stream; any batch may arrive more than once.

Every batch leaves a folder with the latest row of each key that it holds, then an entry in
the table's ledger. A batch in the ledger is skipped; one that failed before its entry is written again
over what it left. Readers take the folders of the ledger alone, and of each key the row that is last
by ``order``, so neither the cut into batches nor their order matters. ``compact`` puts the
folders together; the ledger then names the new one and the batches that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ENTRY = "kind string, batch long"


def _latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows equal in ``order`` (NULL lowest), the one largest in the other columns."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def _enter(spark: SparkSession, path: str, kind: str, batch: int) -> None:
    entry = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(batch).cast("long").alias("batch"))
    entry.write.mode("overwrite").parquet(f"{path}/ledger/{kind}-{batch}")


def _ledger(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last batch that the newest base covers, and the batches entered after it."""
    entries = spark.read.schema(_ENTRY).parquet(f"{path}/ledger/*").collect()
    base = max(e["batch"] for e in entries if e["kind"] == "base")
    return base, sorted(e["batch"] for e in entries if e["kind"] == "batch" and e["batch"] > base)


def create_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table at ``path``, a folder that every executor can reach."""
    spark.createDataFrame([], schema).write.parquet(f"{path}/base-{-1}")
    _enter(spark, path, "base", -1)


def upsert_batch(
    batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str]
) -> bool:
    """Put a batch into the table; False, and nothing changed, if it is there already."""
    spark = batch.sparkSession
    base, entered = _ledger(spark, path)
    if batch_id <= base or batch_id in entered:
        return False
    _latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
    _enter(spark, path, "batch", batch_id)
    return True


def read_table(
    spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]
) -> DataFrame:
    """The table as it is now. NULL keys are a key."""
    base, entered = _ledger(spark, path)
    folders = [f"{path}/base-{base}", *[f"{path}/batch-{b}" for b in entered]]
    return _latest(spark.read.schema(schema).parquet(*folders), keys, order)


def compact(
    spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]
) -> None:
    """One folder for all batches entered so far; older folders stay for readers that have begun.

    Batches must come in the order of their numbers, as a stream gives them: later ones with a number
    that the new folder covers count as entered.
    """
    _, entered = _ledger(spark, path)
    if entered:
        now = read_table(spark, path, schema, keys, order)
        now.write.mode("overwrite").parquet(f"{path}/base-{entered[-1]}")
        _enter(spark, path, "base", entered[-1])


def upsert_stream(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Everything available of a stream into the table; goes on from where it stopped before."""
    query = (
        df.writeStream.foreachBatch(
            lambda batch, number: upsert_batch(batch, number, path, keys, order) and None
        )
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
