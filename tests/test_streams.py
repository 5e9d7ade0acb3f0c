"""Streams fed file by file: late events, repeated events, state over several batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.functions import hundredths
from quernstone.operators import interval_join, tumbling
from quernstone.plans import REGISTRY
from quernstone.session import settings
from quernstone.sources import load, load_stream
from quernstone.streaming import (
    dedup_stream,
    run_append,
    run_to_end,
    run_update,
    running_totals,
    stream_sessions,
    stream_tumbling,
)
from quernstone.plans.events import of_type

T0 = datetime(2024, 1, 1)


def event(event_id, minute, user=1, kind="view", value=1.0):
    return (event_id, T0 + timedelta(minutes=minute), user, kind, value, "{}")


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches as files that a stream reads one after the other."""

    def write(*batches):
        import os

        folder = tmp_path / "events"
        folder.mkdir()
        schema = load(spark, "/root/testdata/sf0.001", "events").schema
        for i, rows in enumerate(batches):
            part = tmp_path / f"part{i}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
            (written,) = part.glob("*.parquet")
            target = folder / f"{i}.parquet"
            os.link(written, target)
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
        return load_stream(spark, str(folder), "events", files_per_batch=1)

    return write


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    """The events table as four files in time order."""
    import os

    folder = tmp_path / "ordered"
    folder.mkdir()
    events = load(spark, sf_dir, "events")
    for i in range(4):
        part = tmp_path / f"ordered{i}"
        low, high = 2500 * i, 2500 * (i + 1)
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(
            1
        ).write.parquet(str(part))
        (written,) = part.glob("*.parquet")
        os.link(written, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return lambda: load_stream(spark, str(folder), "events", files_per_batch=1)


def test_late_event_is_dropped_and_open_window_kept_back(feed):
    stream = feed(
        [event(1, 5), event(2, 30)],
        [event(3, 190)],  # watermark 130: hours 0 and 1 are closed by the next batch
        [event(4, 195)],
        [event(5, 20), event(6, 150), event(7, 200)],  # 5 is late, 6 is not
        [event(8, 400)],  # watermark 340: hours 2 and 3 are closed too
    )
    found = run_append(stream_tumbling(stream, "ts", "1 hour", "1 hour", {}), "late")
    got = sorted((r.window_start, r.n) for r in found.collect())
    assert got == [(T0, 2), (T0 + timedelta(hours=2), 1), (T0 + timedelta(hours=3), 3)]


def test_hourly_over_four_batches_equals_batch(spark, sf_dir, event_files):
    sums = {"total": hundredths("value")}
    streamed = run_append(stream_tumbling(event_files(), "ts", "1 hour", "1 hour", sums), "hours")
    batch = tumbling(load(spark, sf_dir, "events"), "ts", "1 hour", sums).withColumn(
        "window_start", F.col("window_start").cast("timestamp")
    )
    last = load(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    closed = batch.filter(
        F.col("window_start") <= F.lit(last).cast("timestamp") - F.expr("INTERVAL 2 HOURS")
    )
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, closed.collect()))
    assert streamed.count() == 718


def test_session_spans_batches(feed):
    stream = feed(
        [event(1, 0), event(2, 10, user=2)],
        [event(3, 20), event(4, 45)],
        [event(5, 300)],
    )
    found = run_append(stream_sessions(stream, ["user_id"], "ts", "30 minutes", "1 hour"), "s")
    got = sorted((r.user_id, r.session_start, r.session_end, r.n_events) for r in found.collect())
    assert got == [
        (1, T0, T0 + timedelta(minutes=45), 3),
        (2, T0 + timedelta(minutes=10), T0 + timedelta(minutes=10), 1),
    ]


def test_dedup_within_and_across_batches(feed):
    stream = feed(
        [event(1, 0), event(1, 0), event(2, 1)],
        [event(1, 0), event(2, 1), event(3, 2)],
    )
    found = run_append(dedup_stream(stream, ["event_id"], "ts", "1 hour"), "dedup")
    assert sorted(r.event_id for r in found.collect()) == [1, 2, 3]


@pytest.mark.parametrize("rows_per_arrow_batch", ["1", "10000"])
def test_late_copy_does_not_displace_a_timely_one(spark, feed, rows_per_arrow_batch):
    stream = feed(
        [event(1, 0), event(2, 300)],
        [event(3, 310)],  # the watermark is at 240 and more from here on
        [event(50, 5), event(50, 320)],
        [event(99, 400)],
    )
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows_per_arrow_batch):
        found = run_append(dedup_stream(stream, ["event_id"], "ts", "1 hour"), "dedup")
        assert sorted(r.event_id for r in found.collect()) == [1, 2, 3, 50, 99]


def test_run_to_end_returns_open_windows(feed):
    stream = feed(
        [event(1, 5), event(2, 30)],
        [event(3, 190)],
        [event(4, 195)],
        [event(5, 20), event(6, 150), event(7, 200)],  # 5 is late, 6 is not
        [event(8, 400)],
    )
    found = run_to_end(
        stream, "ts", lambda e: stream_tumbling(e, "ts", "1 hour", "1 hour", {}), "to-end"
    )
    got = sorted((r.window_start, r.n) for r in found.collect())
    assert got == [(T0 + timedelta(hours=h), n) for h, n in ((0, 2), (2, 1), (3, 3), (6, 1))]


def test_sessions_to_the_end_over_four_batches(spark, sf_dir, event_files, con):
    found = run_to_end(
        event_files(), "ts",
        lambda e: stream_sessions(e, ["user_id"], "ts", "30 minutes", "1 hour"), "sessions",
    )
    expected = con.sql(REGISTRY["stream_session_windows"].sql).fetchall()
    assert found.count() == len(expected)
    assert sorted(r.session_end.replace(tzinfo=None) for r in found.collect()) == sorted(
        r[2] for r in expected
    )


@pytest.mark.parametrize("seconds, pairs", [(600, 6), (6 * 3600, 246)])
def test_stream_join_over_four_batches_equals_batch(spark, sf_dir, event_files, seconds, pairs):
    def join(events, mark):
        views, clicks = of_type(events(), "view", "view"), of_type(events(), "click", "click")
        if mark:
            views = views.withWatermark("view_ts", "1 hour")
            clicks = clicks.withWatermark("click_ts", "1 hour")
        return interval_join(views, clicks, ["user_id"], "view_ts", "click_ts", seconds)

    streamed = run_append(join(event_files, True), "pairs")
    batch = join(lambda: load(spark, sf_dir, "events"), False)
    got = sorted((r.view_id, r.click_id) for r in streamed.collect())
    assert got == sorted((r.view_id, r.click_id) for r in batch.collect())
    assert len(got) == pairs


def test_totals_grow_over_batches(feed):
    stream = feed(
        [event(1, 0, value=1.25), event(2, 1, user=2, value=0.1)],
        [event(3, 2, value=2.5), event(4, 3, user=3, value=None)],
    )
    found = run_update(running_totals(stream, "user_id", "value"), "totals", ["user_id"])
    assert sorted((r.user_id, r.n, r.cents) for r in found.collect()) == [
        (1, 2, 375),
        (2, 1, 10),
        (3, 1, 0),
    ]
