"""Frequent values, filled grids and the upsert table against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.operators import heavy_hitters, interpolated
from quernstone.operators.heavy_hitters import summaries
from quernstone.sources import load_stream
from quernstone.streaming import compact, create_table, read_table, upsert_batch, upsert_stream

T0 = datetime(2024, 1, 1)


# --- heavy hitters


@pytest.fixture(scope="module")
def skewed(spark):
    """300,000 rows in 13 tasks: a hot value, NULLs, one value just frequent enough, 100,000 rare ones."""
    value = """CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL
               WHEN id % 100 = 2 THEN 'edge' ELSE concat('r', pmod(xxhash64(id), 100000)) END"""
    return spark.range(0, 300_000, 1, 13).selectExpr(f"{value} AS word")


@pytest.mark.parametrize("one_in", [2, 3, 10, 60, 150, 2_000])
def test_heavy_hitters_equal_counts(skewed, one_in):
    counts = {r["word"]: r["count"] for r in skewed.groupBy("word").count().collect()}
    expected = {w: n for w, n in counts.items() if n * one_in >= 300_000}
    found = heavy_hitters(skewed, "word", one_in).collect()
    assert {r["word"]: r["n"] for r in found} == expected and len(found) == len(expected)


def test_threshold_is_met_exactly(spark):
    df = spark.createDataFrame([(1,)] * 25 + [(2,)] * 24 + [(i,) for i in range(10, 61)], "x long")
    assert heavy_hitters(df.repartition(5), "x", 4).collect() == [(1, 25)]
    assert sorted(heavy_hitters(df, "x", 5).collect()) == [(1, 25), (2, 24)]


def test_summaries_stay_bounded_and_bound_the_counts(skewed):
    tasks = skewed.withColumn("task", F.spark_partition_id())
    true = Counter((r["task"], r["word"]) for r in tasks.collect())
    found = summaries(skewed, "word", 20).withColumn("task", F.spark_partition_id()).collect()
    sums = {r["task"]: r for r in found if r["rows"]}
    assert len(sums) == 13 and sum(r["rows"] for r in sums.values()) == 300_000
    held = {(r["task"], r["value"]): r["counted"] for r in found if not r["rows"]}
    assert max(Counter(task for task, _ in held).values()) <= 20
    for r in sums.values():
        assert r["missed"] <= r["rows"] / 21
    for (task, word), n in true.items():
        assert held.get((task, word), 0) <= n <= held.get((task, word), 0) + sums[task]["missed"]


def test_no_rows_have_no_heavy_hitters(spark):
    assert heavy_hitters(spark.createDataFrame([], "x string"), "x", 10).collect() == []
    assert heavy_hitters(spark.createDataFrame([(None,)], "x string"), "x", 10).collect() == [(None, 1)]


# --- grids


def filled(rows, step):
    """Brute force: ``{(key, start second): (value, known)}``."""
    best = defaultdict(dict)
    for key, at, value in rows:
        if at is not None and value is not None:
            start = int((at - T0).total_seconds()) // step
            best[key][start] = max(value, best[key].get(start, value))
    out = {}
    for key, points in best.items():
        starts = sorted(points)
        for a, b in zip(starts, [*starts[1:], None], strict=True):
            out[key, a * step] = (points[a], True)
            for i in range(1, (b - a) if b is not None else 0):
                value = points[a] + (points[b] - points[a]) * i / (b - a)
                out[key, (a + i) * step] = (value, False)
    return out


def test_filled_grid_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6_000):
        key = None if i % 50 == 0 else 1 if i % 3 else rng.randrange(2, 40)
        at = None if i % 97 == 0 else T0 + timedelta(seconds=rng.randrange(200_000), microseconds=i)
        rows.append((key, at, None if i % 89 == 0 else rng.uniform(-5, 5)))
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    found = interpolated(df, ["k"], "ts", "v", 60, rows_per_slice=100).collect()
    ours = {(r["k"], int((r["ts"] - T0).total_seconds())): (r["v"], r["known"]) for r in found}
    assert ours == filled(rows, 60) and len(found) == len(ours)


def test_grid_before_1970_and_single_points(spark):
    rows = [("a", datetime(1969, 12, 31, 22, 30), 1.0), ("a", datetime(1970, 1, 1, 1, 5), 4.0),
            ("b", datetime(2024, 1, 1), 7.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    found = sorted(map(tuple, interpolated(df, ["k"], "ts", "v", 3_600).collect()))
    hours = [datetime(1969, 12, 31, 22), datetime(1969, 12, 31, 23), datetime(1970, 1, 1), datetime(1970, 1, 1, 1)]
    assert found == [("a", h, v, v in (1.0, 4.0)) for h, v in zip(hours, [1.0, 2.0, 3.0, 4.0], strict=True)] + [
        ("b", datetime(2024, 1, 1), 7.0, True)
    ]
    assert interpolated(df.limit(0), ["k"], "ts", "v", 3_600).collect() == []


# --- upserts

SCHEMA = "k int, t long, v string"


def table(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    found = read_table(spark, path, schema, ["k"], ["t"]).collect()
    assert len({r["k"] for r in found}) == len(found)
    return {r["k"]: (r["t"], r["v"]) for r in found}


def last(rows):
    out = {}
    for k, t, v in rows:
        if k not in out or (t is not None, t, v) > (out[k][0] is not None, *out[k]):
            out[k] = (t, v)
    return out


def test_replayed_batches_change_nothing(spark, tmp_path):
    rng = random.Random(2)
    path = (tmp_path / "t").as_uri()
    schema = spark.createDataFrame([], SCHEMA).schema
    create_table(spark, path, schema)
    assert table(spark, path) == {}
    batches = [[(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.randrange(30), f"b{b}-{i}") for i in range(12)]
               for b in range(4)]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for n in range(3):
        assert upsert_batch(frames[n], n, path, ["k"], ["t"])
        before = table(spark, path)
        assert before == last([row for b in batches[: n + 1] for row in b])
        for again in range(n + 1):
            assert not upsert_batch(frames[again], again, path, ["k"], ["t"])
        assert table(spark, path) == before
    compact(spark, path, schema, ["k"], ["t"])
    assert table(spark, path) == before
    assert not upsert_batch(frames[1], 1, path, ["k"], ["t"]) and table(spark, path) == before
    assert upsert_batch(frames[3], 3, path, ["k"], ["t"])
    assert table(spark, path) == last([row for b in batches for row in b])


def test_a_batch_that_failed_before_its_entry_is_not_seen(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    schema = spark.createDataFrame([], SCHEMA).schema
    create_table(spark, path, schema)
    spark.createDataFrame([(1, 9, "half")], SCHEMA).write.parquet(f"{path}/batch-0")
    assert table(spark, path) == {}
    assert upsert_batch(spark.createDataFrame([(1, 1, "whole")], SCHEMA), 0, path, ["k"], ["t"])
    assert table(spark, path) == {1: (1, "whole")}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    events = (tmp_path / "events").as_uri()
    path = (tmp_path / "t").as_uri()
    row = "CAST(id AS LONG) AS event_id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id) AS ts, " \
          "id % 5 AS user_id, 'view' AS event_type, CAST(id AS DOUBLE) AS value, '{}' AS props"  # fmt: skip
    spark.range(0, 100).selectExpr("id").createOrReplaceTempView("upsert_ids")
    spark.sql(f"SELECT {row} FROM upsert_ids").write.parquet(events)
    stream = load_stream(spark, events, "events", files_per_batch=3)
    create_table(spark, path, stream.schema)
    for size in (100, 120):
        upsert_stream(stream, path, ["user_id"], ["ts", "event_id"])
        found = read_table(spark, path, stream.schema, ["user_id"], ["ts", "event_id"]).collect()
        assert sorted(r["event_id"] for r in found) == list(range(size - 5, size))
        spark.range(100, 120).selectExpr("id").createOrReplaceTempView("upsert_ids")
        if size == 100:
            spark.sql(f"SELECT {row} FROM upsert_ids").write.mode("append").parquet(events)
