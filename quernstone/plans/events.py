"""Time-ordered jobs over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import hundredths
from quernstone.operators import (
    asof_join,
    funnel,
    interval_counts,
    interval_join,
    sessionize,
    sliding,
    trailing,
    tumbling,
)
from quernstone.plans.registry import query
from quernstone.sources import load

HOUR = 3600


def of_type(events: DataFrame, event_type: str, prefix: str) -> DataFrame:
    """Events of one type as (user_id, <prefix>_id, <prefix>_ts)."""
    return events.filter(F.col("event_type") == event_type).select(
        "user_id",
        F.col("event_id").alias(f"{prefix}_id"),
        F.col("ts").alias(f"{prefix}_ts"),
    )


@query(
    """
    SELECT v.user_id, v.event_id AS view_id, v.ts AS view_ts,
           p.event_id AS purchase_id, p.ts AS purchase_ts
    FROM (SELECT * FROM events WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
      ON v.user_id = p.user_id AND v.ts >= p.ts
    """
)
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return asof_join(
        of_type(events, "view", "view"),
        of_type(events, "purchase", "purchase"),
        ["user_id"],
        "view_ts",
        "purchase_ts",
        tie_break=["purchase_id"],
    )


#: A hot user's pairs are spread over more cells and tasks; a click is offered to six of them.
SPREAD = {"cells": 2, "salts": 2}
VIEW_CLICK_SQL = """
    SELECT v.user_id, v.event_id AS view_id, v.ts AS view_ts,
           c.event_id AS click_id, c.ts AS click_ts
    FROM events v JOIN events c ON v.user_id = c.user_id
     AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 6 HOUR
    WHERE v.event_type = 'view' AND c.event_type = 'click'
"""


@query(VIEW_CLICK_SQL)
def view_click_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return interval_join(
        of_type(events, "view", "view"),
        of_type(events, "click", "click"),
        ["user_id"],
        "view_ts",
        "click_ts",
        6 * HOUR,
        **SPREAD,
    )


@query(
    """
    SELECT v.user_id, v.event_id AS view_id, v.ts AS view_ts, count(c.event_id) AS n_matches
    FROM (SELECT * FROM events WHERE event_type = 'view') v
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
      ON v.user_id = c.user_id AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 6 HOUR
    GROUP BY ALL
    """
)
def view_click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return interval_counts(
        of_type(events, "view", "view"),
        of_type(events, "click", "click"),
        ["user_id"],
        "view_ts",
        "click_ts",
        6 * HOUR,
    )


@query(
    """
    SELECT event_id, user_id, ts,
           CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w AS avg_value
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    """
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", hundredths("value").alias("value")
    )
    return trailing(
        events,
        ["user_id"],
        "ts",
        ["event_id"],
        6,
        {
            "avg_value": lambda w: F.sum("value").over(w) / 100 / F.count(F.lit(1)).over(w)
        },
    ).drop("value")


SESSIONS_CTE = """
    WITH marked AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                            <= INTERVAL {gap} THEN 0 ELSE 1 END AS starts
        FROM events),
    numbered AS (
        SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts
                                    ROWS UNBOUNDED PRECEDING) AS session FROM marked)
"""


@query(
    SESSIONS_CTE.format(gap="30 MINUTE")
    + """
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_value
    FROM numbered GROUP BY user_id, session
    """
)
def sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessionize(
        load(spark, sf_dir, "events"),
        ["user_id"],
        "ts",
        HOUR // 2,
        {"total_value": hundredths("value")},
    )
    return found.withColumn("total_value", F.col("total_value") / 100)


@query(
    SESSIONS_CTE.format(gap="1 DAY")
    + """
    , s1 AS (SELECT *, min(ts) FILTER (event_type = 'view')
                       OVER (PARTITION BY user_id, session) AS t1 FROM numbered),
    s2 AS (SELECT *, min(ts) FILTER (event_type = 'click' AND ts > t1)
                     OVER (PARTITION BY user_id, session) AS t2 FROM s1),
    s3 AS (SELECT *, min(ts) FILTER (event_type = 'purchase' AND ts > t2)
                     OVER (PARTITION BY user_id, session) AS t3 FROM s2)
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
           CAST(max((t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT)
                AS INTEGER) AS steps_reached
    FROM s3 GROUP BY user_id, session
    """
)
def session_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(
        load(spark, sf_dir, "events"),
        ["user_id"],
        "ts",
        "event_type",
        ["view", "click", "purchase"],
        24 * HOUR,
    )


HOURLY_SQL = """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_value
    FROM events GROUP BY 1
"""


@query(HOURLY_SQL)
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tumbling(
        load(spark, sf_dir, "events"), "ts", "1 hour", {"total_value": hundredths("value")}
    )
    return counts.withColumn("total_value", F.col("total_value") / 100)


@query(
    """
    SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start,
           count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_value
    FROM events CROSS JOIN range(4) AS r(k) GROUP BY 1
    """
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sliding(
        load(spark, sf_dir, "events"),
        "ts",
        "1 hour",
        "15 minutes",
        {"total_value": hundredths("value")},
    )
    return counts.withColumn("total_value", F.col("total_value") / 100)
