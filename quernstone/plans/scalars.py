"""Scalar functions: JSON, words, dates, arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.registry import query
from quernstone.sources import load


@query(
    """
    SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n_events
    FROM events GROUP BY 1
    """
)
def json_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.from_json("props", "k int")["k"].alias("k"))
        .agg(F.count("*").alias("n_events"))
    )


@query(
    """
    SELECT word, count(*) AS n_parts
    FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word
    """
)
def name_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "part")
        .select(F.explode(F.split("p_name", " ")).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n_parts"))
    )


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
           CAST(min(year(o_orderdate)) AS INTEGER) AS year,
           count(*) AS n_orders,
           CAST(sum(datediff('day', o_orderdate, last_ship)) AS BIGINT) AS days_to_last_ship,
           count(*) FILTER (CAST(last_ship AS DATE)
                            > CAST(o_orderdate AS DATE) + 90) AS n_after_90_days
    FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship
                      FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
    GROUP BY 1
    """
)
def date_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    last_ship = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max("l_shipdate").alias("last_ship"))
    )
    shipped, ordered = F.col("last_ship").cast("date"), F.col("o_orderdate").cast("date")
    return (
        load(spark, sf_dir, "orders")
        .join(last_ship, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
        .agg(
            F.min(F.year("o_orderdate")).alias("year"),
            F.count("*").alias("n_orders"),
            F.sum(F.datediff(shipped, ordered)).alias("days_to_last_ship"),
            F.count_if(shipped > F.date_add(ordered, 90)).alias("n_after_90_days"),
        )
    )


@query(
    """
    SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS largest,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6)
               AS squared_length
    FROM embeddings
    """
)
def array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x
    )
    return load(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.array_max("embedding").cast("double").alias("largest"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"),
        F.round(squares, 6).alias("squared_length"),
    )


@query(
    """
    SELECT event_type, string_agg(h::VARCHAR, ',' ORDER BY h) AS hours,
           string_agg(n::VARCHAR, ',' ORDER BY h) AS counts
    FROM (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL)
    GROUP BY event_type
    """
)
def event_type_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A map holds at most 24 entries: the hours are counted before they are collected.
    per_hour = (
        load(spark, sf_dir, "events")
        .groupBy("event_type", F.hour("ts").alias("h"))
        .agg(F.count("*").alias("n"))
    )
    maps = per_hour.groupBy("event_type").agg(
        F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("by_hour")
    )
    hours = F.array_sort(F.map_keys("by_hour"))
    return maps.select(
        "event_type",
        F.array_join(hours.cast("array<string>"), ",").alias("hours"),
        F.array_join(
            F.transform(hours, lambda h: F.element_at("by_hour", h).cast("string")), ","
        ).alias("counts"),
    )
