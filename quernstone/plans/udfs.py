"""The UDF surface. Work that Spark can do itself is done before Python is called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.udfs import Phrases, similarity, smoothed
from quernstone.plans.registry import query
from quernstone.sources import load


@query(
    """
    SELECT p_partkey, p_name, p_type,
           round(jaro_winkler_similarity(upper(p_name), p_type), 6) AS likeness
    FROM part
    """
)
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no join back by the texts, which may be NULL or very frequent; a batch compares each pair once
    return load(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type",
        F.round(similarity(F.upper("p_name"), F.col("p_type")), 6).alias("likeness"),
    )


@query(
    """
    WITH hourly AS (
        SELECT event_type, hour(ts) AS h, avg(value) AS mean FROM events GROUP BY ALL),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) AS i,
               count(*) OVER (PARTITION BY event_type) AS n FROM hourly)
    SELECT event_type,
           round(sum(mean * pow(0.75, n - i) * CASE i WHEN 1 THEN 1 ELSE 0.25 END), 6) AS level
    FROM placed GROUP BY event_type
    """
)
def udf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The aggregate UDF receives at most 24 hourly means per type, not the events.
    hourly = (
        load(spark, sf_dir, "events")
        .groupBy("event_type", F.hour("ts").alias("h"))
        .agg(F.avg("value").alias("mean"))
    )
    return hourly.groupBy("event_type").agg(
        F.round(smoothed("h", "mean", F.lit(0.25)), 6).alias("level")
    )


@query(
    """
    SELECT p_partkey, CAST(a - 1 AS INTEGER) AS position, CAST(b - a + 1 AS INTEGER) AS n_words,
           array_to_string(words[a:b], ' ') AS phrase
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part) AS p,
         range(1, len(words) + 1) AS r(a), range(1, len(words) + 1) AS s(b)
    WHERE a <= b
    """
)
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return Phrases(part.asTable()).select(
        F.col("key").alias("p_partkey"), "position", "n_words", "phrase"
    )
