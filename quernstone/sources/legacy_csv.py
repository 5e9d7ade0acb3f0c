"""CSV in charsets the JVM knows but Spark refuses by default (GBK, CP936, GB18030, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quernstone.session import settings

_ANY_CHARSET = {"spark__sql__legacy__javaCharsets": "true"}
_REPLACED = "\ufffd"  # what a decoder puts in place of bytes it cannot read


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _refuse(bad: Column, text: str, why: str) -> Column:
    error = F.raise_error(F.concat(F.lit(f"{why} in {text}: "), F.col(f"`{text}`")))
    return F.when(bad, error.cast("string")).otherwise(F.col(f"`{text}`"))


def ingest_csv(
    spark: SparkSession, path: str, target: str, schema: StructType | str, charset: str = "UTF-8"
) -> DataFrame:
    """Rewrite a CSV folder as Parquet below ``target`` and return the Parquet table.

    Files are split and parsed in parallel, so a value must not contain a line break.
    The job fails, instead of storing wrong values, on a row that does not fit ``schema``, on a
    header that names other columns or another order, and on bytes that are not of
    ``charset``.
    """
    with settings(spark, **_ANY_CHARSET):
        rows = (
            spark.read.schema(schema)
            .options(header=True, encoding=charset, mode="FAILFAST", enforceSchema=False)
            .csv(path)
        )
        checked = rows.withColumns(
            {c: _refuse(F.col(f"`{c}`").contains(_REPLACED), c, "unreadable bytes") for c in _texts(rows)}
        )
        checked.write.mode("overwrite").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def write_csv(df: DataFrame, path: str, charset: str = "UTF-8") -> None:
    """Write CSV with a header. Text that ``charset`` lacks, or with a line break, fails the job."""
    with settings(df.sparkSession, **_ANY_CHARSET):
        checked = df
        for c in _texts(df):
            # encode() itself raises on text outside the charset; its length makes it run
            lacks = F.length(F.encode(F.col(f"`{c}`"), charset)) < 0
            checked = checked.withColumn(
                c, _refuse(lacks | F.col(f"`{c}`").rlike("[\\r\\n]"), c, "line break")
            )
        checked.write.mode("overwrite").options(header=True, encoding=charset).csv(path)
