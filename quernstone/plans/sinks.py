"""Round trips through the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.registry import query
from quernstone.session import scratch
from quernstone.sources import ingest_csv, load, write_csv, write_partitioned

# Chinese names of the part types, so that the round trip has text outside ASCII
_LABELS = {
    "ECONOMY": "经济",
    "LARGE": "大型",
    "MEDIUM": "中型",
    "PROMO": "促销",
    "SMALL": "小型",
    "STANDARD": "标准",
}


@query("SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders")
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orders-by-year")
    orders = load(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate"))
    write_partitioned(orders, path, ["o_year"])
    return spark.read.schema(orders.schema).parquet(path)


@query(
    "SELECT *, CASE p_type "
    + " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in _LABELS.items())
    + " END AS type_label FROM part"
)
def legacy_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*[F.lit(text) for pair in _LABELS.items() for text in pair])
    parts = load(spark, sf_dir, "part").withColumn(
        "type_label", F.try_element_at(labels, F.col("p_type"))
    )
    base = scratch(spark, "parts-gbk")
    write_csv(parts, f"{base}/csv", "GBK")
    return ingest_csv(spark, f"{base}/csv", f"{base}/parquet", parts.schema, "GBK")
