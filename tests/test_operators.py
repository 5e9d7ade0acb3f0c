"""Reusable operators on hand-made rows, and on the events with every key treated as hot."""

from __future__ import annotations

import bisect
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from compare import difference
from quernstone.functions import exact_sum, hundredths, shifted
from quernstone.operators import (
    asof_join,
    except_all,
    exact_percentiles,
    funnel,
    intersect_all,
    interval_counts,
    interval_join,
    sessionize,
    sliding,
    top_k_per_key,
    trailing,
)
from quernstone.operators.hot_keys import cut_keys, in_slices
from quernstone.plans import REGISTRY
from quernstone.plans.events import HOUR, of_type
from quernstone.sources import load

T0 = datetime(2024, 1, 1)
SLICES = [1_000_000, 5]  # few slices, and slices of about 5 rows


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def skewed_rows(n=600, seed=3):
    """A third of the rows in key 1, most of them in one burst, with equal timestamps."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if i % 3 == 0 else rng.randrange(2, 40)
        second = 5000 + rng.randrange(100) if key == 1 and i % 6 else rng.randrange(20000)
        rows.append((i, key, at(second), rng.choice("abcd")))
    return rows


SKEWED = "id long, key long, ts timestamp_ntz, kind string"


def test_slices_are_even_and_ordered(spark):
    """1,500 keys of 20 rows, one key of 10,000 with one timestamp, and NULL times: all cut alike."""
    rows = [(i, i % 1_500, at(i % 977), "a") for i in range(30_000)]
    rows += [(i, 7_000, at(5), "a") for i in range(30_000, 40_000)]
    rows += [(i, 7_001, None, "a") for i in range(40_000, 45_000)]
    df = spark.createDataFrame(rows, SKEWED)
    sliced = in_slices(df, ["key"], [F.col("ts"), F.col("id")], rows_per_slice=1_000)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert sum(sizes) == 45_000 and len(sizes) > 30 and max(sizes) <= 2_500
    ordered = sliced.groupBy("key", "_slice").agg(
        F.min(F.struct("ts", "id")).alias("low"), F.max(F.struct("ts", "id")).alias("high")
    ).orderBy("key", "_slice").collect()
    for a, b in zip(ordered, ordered[1:]):
        if a.key == b.key:
            assert (a.high.ts or T0, a.high.id) < (b.low.ts or T0, b.low.id)
    in_several = defaultdict(set)
    for r in sliced.select("key", "_slice").distinct().collect():
        in_several[r.key].add(r._slice)
    cut = {r.key for r in cut_keys(sliced, ["key"]).select("key").distinct().collect()}
    assert cut == {k for k, v in in_several.items() if len(v) > 1}
    assert {7_000, 7_001} <= cut and len(cut) < len(sizes)


# --- exact sums -------------------------------------------------------------------------


def test_sums_are_exact_in_any_partitions(spark):
    for n in (3, 16):
        df = spark.range(0, 2_000_000, 1, n).select(
            (F.lit(90_000_000_000_000_000) + F.col("id")).alias("v"), (-F.col("id")).alias("w")
        )
        row = df.agg(exact_sum(F.col("v")).alias("v"), exact_sum(F.col("w")).alias("w")).first()
        ids = 2_000_000 * 1_999_999 // 2
        assert int(row.v) == 2_000_000 * 90_000_000_000_000_000 + ids and int(row.w) == -ids
    assert df.where("false").agg(exact_sum(F.col("v")).alias("v")).first().v is None
    big = spark.range(1).select(F.lit(96_710_009_400_042_480).alias("v"))
    assert big.select(shifted(F.col("v").cast("decimal(38,0)"), 4)).first()[0] == 9671000940004.248


def test_more_than_two_decimals_are_refused(spark):
    df = spark.createDataFrame([(v,) for v in (0.07, 1.15, -2.675e3, 104997.88, None, 1e12)], "v double")
    got = [r[0] for r in df.select(hundredths("v")).collect()]
    assert got == [7, 115, -267_500, 10_499_788, None, 10**14]
    for bad in (0.004, 12.345, float("nan"), float("inf")):
        one = spark.createDataFrame([(bad,)], "v double")
        with pytest.raises(Exception, match="two decimals"):
            one.select(hundredths("v")).collect()
        with pytest.raises(Exception, match="two decimals"):
            one.agg(exact_sum(hundredths("v"))).collect()


# --- set operations ---------------------------------------------------------------------


def test_bag_operations_equal_built_in(spark):
    l = spark.createDataFrame([(1,)] * 5 + [(2,)] + [(None,)] * 3 + [(4,)], "k int")
    r = spark.createDataFrame([(1,)] * 2 + [(2,)] * 4 + [(None,)], "k int")
    for ours, theirs in ((except_all(l, r), l.exceptAll(r)), (intersect_all(l, r), l.intersectAll(r))):
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    hot = spark.range(250_000).select(F.lit(9).alias("k"))
    assert except_all(hot, hot.limit(10)).count() == 249_990
    assert except_all(hot, hot.limit(10)).groupBy(F.spark_partition_id()).count().count() > 1


# --- as-of join -------------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_slice", SLICES)
def test_asof_ties_nulls_and_unmatched(spark, rows_per_slice):
    left = spark.createDataFrame(
        [(1, "a", at(10)), (2, "a", at(5)), (3, "b", at(10)), (4, None, at(10)), (5, "a", None),
         (6, "a", at(4))],
        "lid int, k string, lts timestamp_ntz",
    )
    right = spark.createDataFrame(
        [(1, "a", at(5)), (2, "a", at(5)), (3, "a", at(11)), (4, None, at(1)), (5, "a", None),
         (6, "c", at(1))],
        "rid int, k string, rts timestamp_ntz",
    )
    found = asof_join(left, right, ["k"], "lts", "rts", ["rid"], rows_per_slice)
    got = {r.lid: r.rid for r in found.collect()}
    # equal time matches, the greater rid wins a tie, NULL keys and times never match
    assert got == {1: 2, 2: 2, 3: None, 4: None, 5: None, 6: None}


def brute_asof(left, right):
    out = []
    for lid, key, ts, _ in left:
        best = max(
            ((r_ts, rid) for rid, r_key, r_ts, _ in right if r_key == key and r_ts <= ts),
            default=(None, None),
        )
        out.append((lid, best[1]))
    return sorted(out)


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 40, 7])
def test_asof_with_a_hot_key_equals_brute_force(spark, rows_per_slice):
    rows = skewed_rows()
    left = [r for r in rows if r[3] in "ab"]
    right = [r for r in rows if r[3] == "c"]
    l = spark.createDataFrame(left, SKEWED).drop("kind").withColumnRenamed("id", "lid")
    r = spark.createDataFrame(right, SKEWED).select(
        "key", F.col("id").alias("rid"), F.col("ts").alias("rts")
    )
    found = asof_join(l, r, ["key"], "ts", "rts", ["rid"], rows_per_slice)
    assert sorted((x.lid, x.rid) for x in found.collect()) == brute_asof(left, right)


def test_asof_on_events_in_slices(spark, sf_dir, con):
    events = load(spark, sf_dir, "events")
    views, purchases = of_type(events, "view", "view"), of_type(events, "purchase", "purchase")
    found = asof_join(views, purchases, ["user_id"], "view_ts", "purchase_ts", ["purchase_id"], 100)
    assert difference(found, con, REGISTRY["asof_last_purchase"].sql) == ""


def test_asof_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", at(1))], "lid int, k string, lts timestamp_ntz")
    right = spark.createDataFrame([], "rid int, k string, rts timestamp_ntz")
    assert [tuple(r) for r in asof_join(left, right, ["k"], "lts", "rts").collect()] == [
        (1, "a", at(1), None, None)
    ]
    assert asof_join(left.limit(0), right, ["k"], "lts", "rts").count() == 0


# --- interval join ----------------------------------------------------------------------


@pytest.mark.parametrize("cells, salts", [(1, 1), (3, 1), (7, 3), (1, 5)])
def test_interval_join_equals_brute_force(spark, cells, salts):
    rows = skewed_rows()
    l = spark.createDataFrame(rows, SKEWED).select("key", F.col("id").alias("a"), F.col("ts").alias("ats"))
    r = spark.createDataFrame(rows, SKEWED).select("key", F.col("id").alias("b"), F.col("ts").alias("bts"))
    limit = timedelta(seconds=100)
    expected = sorted(
        (x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] < y[2] <= x[2] + limit
    )
    found = interval_join(l, r, ["key"], "ats", "bts", 100, cells, salts)
    assert sorted((p.a, p.b) for p in found.collect()) == expected


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 25, 5])
def test_interval_counts_equal_brute_force(spark, rows_per_slice):
    rows = skewed_rows()
    l = spark.createDataFrame(rows, SKEWED).select("key", F.col("id").alias("a"), F.col("ts").alias("ats"))
    r = spark.createDataFrame(rows, SKEWED).select("key", F.col("ts").alias("bts"))
    limit = timedelta(seconds=100)
    expected = {
        x[0]: sum(x[1] == y[1] and x[2] < y[2] <= x[2] + limit for y in rows) for x in rows
    }
    found = interval_counts(l, r, ["key"], "ats", "bts", 100, rows_per_slice)
    got = found.collect()
    assert len(got) == len(rows)
    assert {p.a: p.n_matches for p in got} == expected


def test_interval_counts_of_equal_rows(spark):
    l = spark.createDataFrame([("k", at(0), {"a": 1})] * 2 + [("k", at(5), None)],
                              "k string, a timestamp_ntz, m map<string,int>")
    r = spark.createDataFrame([("k", at(1)), ("k", at(1)), ("k", at(6))], "k string, b timestamp_ntz")
    for rows_per_slice in (1_000_000, 1):
        found = interval_counts(l, r, ["k"], "a", "b", 3, rows_per_slice).collect()
        assert sorted((p.a, p.n_matches) for p in found) == [(at(0), 2), (at(0), 2), (at(5), 1)]
        assert found[0].asDict().keys() == {"k", "a", "m", "n_matches"}


def test_interval_counts_edges_and_nulls(spark):
    l = spark.createDataFrame(
        [("k", at(0)), (None, at(0)), ("k", None), ("other", at(0))], "k string, a timestamp_ntz"
    )
    r = spark.createDataFrame(
        [("k", at(0)), ("k", at(1)), ("k", at(10)), ("k", at(10.000001)), ("k", None), (None, at(1))],
        "k string, b timestamp_ntz",
    )
    for rows_per_slice in (1_000_000, 1):
        found = interval_counts(l, r, ["k"], "a", "b", 10, rows_per_slice)
        got = {(p.k, p.a): p.n_matches for p in found.collect()}
        assert got == {("k", at(0)): 2, (None, at(0)): 0, ("k", None): 0, ("other", at(0)): 0}


def test_interval_edges_and_nulls(spark):
    l = spark.createDataFrame([("k", at(0)), (None, at(0)), ("k", None)], "k string, a timestamp_ntz")
    r = spark.createDataFrame(
        [("k", at(0)), ("k", at(1)), ("k", at(10)), ("k", at(10.000001)), ("k", None), (None, at(1))],
        "k string, b timestamp_ntz",
    )
    found = interval_join(l, r, ["k"], "a", "b", 10)
    assert sorted(x.b for x in found.collect()) == [at(1), at(10)]


# --- sessions and funnels ---------------------------------------------------------------


def test_sessions_split_at_exactly_the_gap(spark):
    rows = [("k", at(s)) for s in (0, 9.999999, 20, 30, 40.000001, 49)] + [("k", None), (None, at(1))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    found = sessionize(df, ["k"], "ts", 10).filter("k = 'k'").orderBy("session_start")
    built_in = (
        df.filter("k = 'k' AND ts IS NOT NULL")
        .groupBy("k", F.session_window("ts", "10 seconds").alias("w"))
        .agg(F.max("ts").alias("session_end"), F.count("*").alias("n"))
        .orderBy("w.start")
    )
    got = [(r.session_start, r.session_end, r.n_events) for r in found.collect()]
    assert got == [(at(0), at(9.999999), 2), (at(20), at(30), 2), (at(40.000001), at(49), 2)]
    assert got == [(r.w.start, r.session_end, r.n) for r in built_in.collect()]


def test_sessions_before_1970_and_sums(spark):
    base = datetime(1969, 12, 31, 23, 59, 58)
    rows = [("k", base + timedelta(seconds=s), 1.5) for s in range(5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    (only,) = sessionize(df, ["k"], "ts", 3, {"total": hundredths("v")}).collect()
    assert (only.session_start, only.n_events, only.total) == (base, 5, 750.0)


def brute_funnel(rows, steps, gap):
    by_key = defaultdict(list)
    for _, key, ts, kind in rows:
        by_key[key].append((ts, kind))
    out = []
    for key, events in by_key.items():
        events.sort()
        sessions, last = [], None
        for ts, kind in events:
            if last is None or (ts - last).total_seconds() > gap:
                sessions.append([])
            sessions[-1].append((ts, kind))
            last = ts
        for session in sessions:
            before, reached = None, 0
            for step in steps:
                times = [t for t, k in session if k == step and (before is None or t > before)]
                if not times:
                    break
                before, reached = min(times), reached + 1
            out.append((key, session[0][0], session[-1][0], len(session), reached))
    return sorted(out)


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 30])
@pytest.mark.parametrize("steps", ["a", "ab", "abc", "abcd", "aba"])
def test_funnel_equals_brute_force(spark, steps, rows_per_slice):
    rows = skewed_rows(400)
    found = funnel(
        spark.createDataFrame(rows, SKEWED), ["key"], "ts", "kind", list(steps), 700, rows_per_slice
    )
    got = sorted(
        (r.key, r.session_start, r.session_end, r.n_events, r.steps_reached)
        for r in found.collect()
    )
    assert got == brute_funnel(rows, steps, 700)


def test_funnel_on_events_in_slices(spark, sf_dir, con):
    events = load(spark, sf_dir, "events")
    found = funnel(
        events, ["user_id"], "ts", "event_type", ["view", "click", "purchase"], 24 * HOUR, 200
    )
    assert difference(found, con, REGISTRY["session_funnel"].sql) == ""


# --- windows ----------------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 20, 4])
@pytest.mark.parametrize("preceding", [1, 6])
def test_trailing_with_a_hot_key_equals_plain_window(spark, rows_per_slice, preceding):
    rows = spark.createDataFrame(skewed_rows(), SKEWED)
    found = trailing(
        rows, ["key"], "ts", ["id"], preceding,
        {"ids": lambda w: F.collect_list("id").over(w)}, rows_per_slice,
    )
    by_key = defaultdict(list)
    for row in sorted(skewed_rows(), key=lambda r: (r[2], r[0])):
        by_key[row[1]].append(row[0])
    expected = {
        i: ids[max(0, pos - preceding) : pos + 1]
        for ids in by_key.values()
        for pos, i in enumerate(ids)
    }
    got = found.collect()
    assert len(got) == 600
    assert {r.id: r.ids for r in got} == expected
    assert found.columns == [*rows.columns, "ids"]


def test_top_k_ties_and_partial_limit(spark):
    df = spark.createDataFrame(
        [("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 4, None), (None, 5, 1)],
        "k string, id int, v int",
    )
    top = top_k_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 2)
    assert sorted((r.k or "", r.id, r.rank) for r in top.collect()) == [
        ("", 5, 1), ("a", 1, 2), ("a", 3, 1), ("b", 4, 1),
    ]


def test_sliding_equals_built_in_window(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    ours = sliding(events, "ts", "1 hour", "15 minutes", {"total": hundredths("value")})
    built_in = (
        events.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"))
        .agg(F.count("*").alias("n"), F.sum(hundredths("value")).alias("total"))
        .select(F.col("w.start").alias("window_start"), "n", "total")
    )
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, built_in.collect()))


@pytest.mark.parametrize("width, step", [("50 minutes", "20 minutes"), ("90 seconds", "1 minute")])
def test_sliding_by_steps_that_do_not_divide(spark, sf_dir, width, step):
    events = load(spark, sf_dir, "events").limit(1_000)
    ours = sliding(events, "ts", width, step, {})
    built_in = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, ours.collect())) == sorted(
        (r.w.start, r.n) for r in built_in.collect()
    )
    with pytest.raises(ValueError):
        sliding(events, "ts", "1 month", "1 day", {})


# --- percentiles ------------------------------------------------------------------------


def interpolated(values, share):
    values = sorted(values)
    rank = (len(values) - 1) * share
    low = int(rank)
    high = low if rank == low else low + 1
    return values[low] + (values[high] - values[low]) * (rank - low)


def test_percentiles_without_keys_and_of_many_groups(spark):
    df = spark.range(30_000).select((F.col("id") % 12_000).alias("k"), F.sqrt("id").alias("v"))
    (row,) = exact_percentiles(df, [], "v", {"p50": 0.5}, rows_per_slice=700).collect()
    assert row.p50 == pytest.approx(interpolated([i**0.5 for i in range(30_000)], 0.5), abs=1e-12)
    many = exact_percentiles(df, ["k"], "v", {"p50": 0.5}, rows_per_slice=1_000).collect()
    by = defaultdict(list)
    for i in range(30_000):
        by[i % 12_000].append(i**0.5)
    assert len(many) == 12_000
    assert all(r.p50 == pytest.approx(interpolated(by[r.k], 0.5), abs=1e-12) for r in many)
    assert exact_percentiles(df.where("false"), [], "v", {"p": 0.5}).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 10_001, 60_000])
def test_percentiles_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, rng.gauss(0, 1), rng.expovariate(1) ** 6]) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p9999": 0.9999, "p100": 1.0}
    (row,) = exact_percentiles(df.repartition(5), ["k"], "v", shares).collect()
    assert row.k == "a"
    for name, share in shares.items():
        assert row[name] == pytest.approx(interpolated(values, share), abs=1e-12), name


def test_percentile_of_many_copies(spark):
    df = spark.range(50_000).select(
        F.lit(None).cast("string").alias("k"),
        F.when(F.col("id") < 49_000, 7.0).otherwise(F.col("id").cast("double")).alias("v"),
    )
    (row,) = exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()
    assert (row.p50, row.p99) == (7.0, pytest.approx(49_499.01))


def test_registered_pair_joins_spread_hot_users(spark, sf_dir, monkeypatch):
    from quernstone.plans import REGISTRY, events, streams

    class Called(Exception):
        pass

    def called(*args, cells=1, salts=1):
        raise Called(cells, salts)

    for module, name in ((events, "view_click_interval"), (streams, "stream_view_click")):
        monkeypatch.setattr(module, "interval_join", called)
        with pytest.raises(Called) as spread:
            REGISTRY[name].run(spark, sf_dir)
        assert min(spread.value.args) > 1
