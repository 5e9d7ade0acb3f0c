"""Structured Streaming jobs: the events table as a stream, run over all that is available.

The results are read back from the sink, so each query returns a batch table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import hundredths, micros
from quernstone.operators import interval_join
from quernstone.plans.events import HOUR, HOURLY_SQL, SESSIONS_CTE, SPREAD, VIEW_CLICK_SQL, of_type
from quernstone.plans.registry import query
from quernstone.session import scratch
from quernstone.sources import load, load_stream
from quernstone.streaming import (
    compact,
    create_table,
    dedup_stream,
    read_table,
    run_append,
    run_to_end,
    run_update,
    running_totals,
    stream_sessions,
    stream_tumbling,
    upsert_stream,
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The braces make the path a pattern, which may name one file as well as a folder.
    return load_stream(spark, f"{sf_dir}/{{events}}.parquet", "events")


def _without_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    HOURLY_SQL
)
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run_to_end(
        _events(spark, sf_dir),
        "ts",
        lambda events: stream_tumbling(
            events, "ts", "1 hour", "1 hour", {"total_value": hundredths("value")}
        ),
        "hourly",
    )
    return _without_zone(
        counts.withColumn("total_value", F.col("total_value") / 100), "window_start"
    )


_QUARTERS, _FILES = 4, 4  # batches, and files of each


@query(HOURLY_SQL)
def stream_hourly_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bounded batches in time order, the last with copies of all events of the first.

    The watermark has closed their hours by then, so they must be dropped; rows out of
    order within a batch must not.
    """
    events = load(spark, sf_dir, "events")
    low, high = events.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    if low is None:
        low, high = 0, 0
    quarter = F.least(
        F.floor((micros("ts") - low) * _QUARTERS / F.lit(max(1, high - low))), F.lit(_QUARTERS - 1)
    )
    numbered = events.withColumn("quarter", quarter)
    folder = scratch(spark, "events-in-batches")
    for i in range(_QUARTERS):  # written one after the other: the source reads by age
        batch = numbered.where(F.col("quarter") == i)
        if i == _QUARTERS - 1:
            batch = batch.unionAll(numbered.where(F.col("quarter") == 0))
        batch.drop("quarter").repartition(_FILES).write.parquet(f"{folder}/batch={i}")
    span = max(1, (high - low) // 1_000_000)
    counts = run_to_end(
        load_stream(spark, f"{folder}/*", "events", files_per_batch=_FILES),
        "ts",
        # Spark drops what the batch before the last one has closed: all of the first quarter
        lambda stream: stream_tumbling(
            stream, "ts", "1 hour", f"{span // 8} seconds", {"total_value": hundredths("value")}
        ),
        "hourly-late",
    )
    return _without_zone(
        counts.withColumn("total_value", F.col("total_value") / 100), "window_start"
    )


@query(
    SESSIONS_CTE.format(gap="30 MINUTE")
    + """
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
    FROM numbered GROUP BY user_id, session
    """
)
def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_to_end(
        _events(spark, sf_dir),
        "ts",
        lambda events: stream_sessions(events, ["user_id"], "ts", "30 minutes", "1 hour"),
        "sessions",
    )
    return _without_zone(found, "session_start", "session_end")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every event arrives twice
    twice = _events(spark, sf_dir).unionByName(_events(spark, sf_dir))
    return _without_zone(
        run_append(dedup_stream(twice, ["event_id"], "ts", "1 hour"), "dedup"), "ts"
    )


@query(VIEW_CLICK_SQL)
def stream_view_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = of_type(_events(spark, sf_dir), "view", "view").withWatermark("view_ts", "1 hour")
    clicks = of_type(_events(spark, sf_dir), "click", "click").withWatermark("click_ts", "1 hour")
    pairs = interval_join(views, clicks, ["user_id"], "view_ts", "click_ts", 6 * HOUR, **SPREAD)
    return _without_zone(run_append(pairs, "view-click"), "view_ts", "click_ts")


@query(
    """
    SELECT user_id, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(12,2))) * 100 AS BIGINT) AS cents
    FROM events GROUP BY user_id
    """
)
def stream_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = running_totals(_events(spark, sf_dir), "user_id", "value")
    return run_update(totals, "user-totals", ["user_id"])


@query(
    """
    SELECT user_id, event_id, ts, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """
)
def stream_user_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, upserted in batches out of time order, then compacted."""
    folder, path = scratch(spark, "events-by-hash"), scratch(spark, "user-latest")
    load(spark, sf_dir, "events").repartition(_QUARTERS * _FILES, "event_id").write.parquet(folder)
    events = load_stream(spark, folder, "events", files_per_batch=_FILES).drop("props")
    table = (path, events.schema, ["user_id"], ["ts", "event_id"])
    create_table(spark, *table[:2])
    upsert_stream(events, path, *table[2:])
    compact(spark, *table)
    return _without_zone(read_table(spark, *table), "ts")
