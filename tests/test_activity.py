"""Sketches, row patterns, overlapping intervals and trailing users against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from compare import difference
from quernstone.operators import VALLEYS, Automaton, matches, overlap_join, trailing_distinct
from quernstone.operators.sketches import merged, n_in_both, n_members, n_values, quantile, sketched
from quernstone.plans import REGISTRY
from quernstone.sources import load

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


# --- sketches


@pytest.fixture(scope="module")
def sketches(spark):
    """40 days; the key "hot" has a third of all rows; some members and values are NULL."""
    df = spark.range(600_000).selectExpr(
        "CAST(id % 40 AS INT) AS day",
        "IF(id % 3 = 0, 'hot', concat('k', pmod(xxhash64(id), 5))) AS k",
        "IF(id % 101 = 0, NULL, pmod(xxhash64(id, 1), 50000)) AS member",
        "IF(id % 103 = 0, NULL, pow(pmod(xxhash64(id, 2), 100000) / 1000.0, 2)) AS value",
    )
    return df, sketched(df, ["day", "k"], "member", "value")


def test_merged_members_are_close_also_for_a_hot_key(sketches):
    df, daily = sketches
    exact = {r["k"]: r for r in df.groupBy("k").agg(
        F.count("*").alias("n"), F.countDistinct("member").alias("m")).collect()}
    found = merged(daily, ["k"]).select("k", "n", n_members("members").alias("m")).collect()
    assert len(found) == len(exact) == 6
    for r in found:
        assert r["n"] == exact[r["k"]]["n"]
        assert abs(r["m"] - exact[r["k"]]["m"]) <= 0.05 * exact[r["k"]]["m"]  # three errors of 1.6 %


def test_merged_quantiles_are_close_in_rank(sketches):
    df, daily = sketches
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    found = merged(daily, ["k"]).select(
        "k", n_values("values").alias("n"), quantile("values", 0.0).alias("low"),
        quantile("values", 1.0).alias("high"),
        F.array(*[quantile("values", s) for s in shares]).alias("q"),
    )
    counted = df.where("value IS NOT NULL").join(found, "k").groupBy("k").agg(
        F.count("*").alias("rows"), F.first("n").alias("n"), F.first("low").alias("low"),
        F.first("high").alias("high"), F.min("value").alias("min"), F.max("value").alias("max"),
        *[F.count_if(F.col("value") <= F.col("q")[i]).alias(f"r{i}") for i in range(len(shares))],
    )
    for r in counted.collect():
        assert (r["n"], r["low"], r["high"]) == (r["rows"], r["min"], r["max"])
        for i, s in enumerate(shares):
            assert abs(r[f"r{i}"] / r["rows"] - s) <= 0.02


def test_sketches_without_members_or_values(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", 1, 2.0), (None, 1, 3.0)],
                               "k string, member long, value double")
    found = merged(sketched(df, ["k"], "member", "value"), ["k"]).select(
        "k", "n", n_members("members"), n_values("values"), quantile("values", 0.5)
    )
    assert sorted(map(tuple, found.collect()), key=repr) == [
        ("a", 2, 0, 0, None), ("b", 1, 1, 1, 2.0), (None, 1, 1, 1, 3.0)
    ]
    assert sketched(df.limit(0), ["k"], "member", "value").collect() == []


def test_members_in_both(spark):
    df = spark.range(3_000).selectExpr("id AS member", "1.0 AS value", "id % 3 AS k")
    more = spark.range(500, 2_500).selectExpr("id AS member", "1.0 AS value", "9L AS k")
    s = sketched(df.unionAll(more), ["k"], "member", "value")
    a, b = s.where("k = 0").select(F.col("members").alias("a")), s.where("k = 9").select(
        F.col("members").alias("b"))
    (n,) = a.join(b).select(n_in_both("a", "b")).first()
    assert n == len([i for i in range(500, 2_500) if i % 3 == 0])


# --- row patterns


def scan(rows, automaton):
    """The automaton over one key's rows (time, symbol), in plain Python."""
    out, state, begun, n, best = [], 0, None, 0, None
    for t, symbol in [*rows, (None, "no such symbol")]:
        to = automaton.moves[state].get(symbol, 0)
        if to and (state == 0 or (state, symbol) in automaton.begins) or not to:
            if best:
                out.append(best)
            begun, n, best = t, 0, None
        state = to
        n += 1
        if state in automaton.accepts:
            best = (begun, t, n)
    return out


#: a, then any number of b or c, then d; e may follow
NESTED = Automaton(
    moves=({"a": 1}, {"b": 1, "c": 1, "d": 2}, {"e": 2, "a": 1}), accepts=frozenset({2}),
    begins=frozenset({(2, "a")}),
)


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 7])
@pytest.mark.parametrize("automaton", [VALLEYS, NESTED])
def test_matches_of_a_hot_key_in_many_slices(spark, automaton, rows_per_slice):
    rng = random.Random(2)
    symbols = ["fall", "rise", None] if automaton is VALLEYS else ["a", "b", "c", "b", "d", "e", "x"]
    rows, whose = [], defaultdict(list)
    for i in range(700):
        key = ("hot", 1) if i % 3 == 0 else (rng.choice(["k", None]), rng.choice([1, 2**60, None]))
        if key[0] == "hot" and i % 9:  # long stretches in one state
            symbol = "rise" if automaton is VALLEYS else "b"
        else:
            symbol = rng.choice(symbols)
        t = rng.randrange(400)
        rows.append((*key, at(t), i, symbol))
        whose[key].append((t, i, symbol))
    df = spark.createDataFrame(rows, "k string, j long, ts timestamp_ntz, i long, symbol string")
    expected = Counter()
    for key, own in whose.items():
        for start, end, n in scan([(t, s) for t, _, s in sorted(own, key=lambda r: r[:2])], automaton):
            expected[*key, at(start), at(end), n] += 1
    found = matches(df.repartition(3), ["k", "j"], "ts", ["i"], F.col("symbol"), automaton, rows_per_slice)
    assert Counter(map(tuple, found.collect())) == expected
    assert len(expected) > 10


def test_matches_without_time_and_without_rows(spark):
    schema = "k long, ts timestamp, i long, symbol string"
    rows = [(1, None, 1, "fall"), (1, at(5), 2, "rise"), (1, at(6), 3, "rise")]
    found = matches(spark.createDataFrame(rows, schema), ["k"], "ts", ["i"], F.col("symbol"), VALLEYS)
    assert [tuple(r) for r in found.collect()] == [(1, None, at(6), 3)]
    none = matches(spark.createDataFrame([], schema), ["k"], "ts", ["i"], F.col("symbol"), VALLEYS)
    assert none.collect() == []


# --- overlapping intervals


def spans(spark, rows, name):
    return spark.createDataFrame(rows, f"k long, {name}_id long, {name}_a timestamp_ntz, {name}_b timestamp_ntz")


def brute_overlaps(left, right):
    return Counter(
        (a[0], a[1], b[1]) for a in left for b in right
        if None not in (a[0], b[0], *a[2:], *b[2:]) and a[0] == b[0]
        and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]
    )


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randrange(-50_000, 50_000)
            length = rng.choice([0, 0, 1, 7, 60, 3_600, 40_000, -1])
            out.append((rng.choice([1, 1, 2, None]), i, at(a), at(a + length)))
        return [*out, (1, n, at(3), None), (1, n + 1, None, at(3)), (1, 0, at(10), at(20)), (1, 0, at(10), at(20))]

    left, right = some(250), some(200)
    found = overlap_join(spans(spark, left, "l"), spans(spark, right, "r"), ["k"], ("l_a", "l_b"), ("r_a", "r_b"))
    assert Counter((r["k"], r["l_id"], r["r_id"]) for r in found.collect()) == brute_overlaps(left, right)


def test_a_year_long_interval_does_not_multiply_short_ones(spark):
    year = 365 * 86_400
    left = [(1, i, at(i * 600), at(i * 600 + 60)) for i in range(2_000)] + [(1, 9_999, at(0), at(year))]
    right = [(1, i, at(i * 700), at(i * 700 + 30)) for i in range(2_000)]
    l, r = spans(spark, left, "l"), spans(spark, right, "r")
    found = overlap_join(l, r, ["k"], ("l_a", "l_b"), ("r_a", "r_b"))
    assert Counter((x["k"], x["l_id"], x["r_id"]) for x in found.collect()) == brute_overlaps(left, right)
    from quernstone.operators.overlaps import _level

    assert l.select(_level(("l_a", "l_b")).alias("v")).distinct().count() == 2  # copies of a start


def test_overlaps_need_different_names(spark):
    l = spans(spark, [(1, 1, at(0), at(1))], "l")
    with pytest.raises(ValueError, match="l_id"):
        overlap_join(l, l, ["k"], ("l_a", "l_b"), ("l_a", "l_b"))
    assert overlap_join(l.limit(0), spans(spark, [], "r"), ["k"], ("l_a", "l_b"), ("r_a", "r_b")).count() == 0


# --- trailing users


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_trailing_users_with_gaps_nulls_and_a_hot_user(spark, keys):
    rng = random.Random(6)
    rows = [(rng.choice(["x", None]), rng.choice([None, 1, 2, 3, 4, 5]),
             T0.date() + timedelta(days=rng.choice([0, 1, 2, 3, 9, 10, 40, 41, 90])))
            for _ in range(150)]
    rows += [("x", 1, T0.date() + timedelta(days=d)) for d in range(30)] * 20
    rows += [("x", 7, None)]
    df = spark.createDataFrame(rows, "k string, who long, d date")
    widths = {"w1": 1, "w7": 7, "w30": 30}
    found = trailing_distinct(df, F.col("d"), "who", widths, keys)
    expected = set()
    for key in {r[0] if keys else "all" for r in rows}:
        own = [r for r in rows if (not keys or r[0] == key) and r[2]]
        first, last = min(r[2] for r in own), max(r[2] for r in own)
        for n in range((last - first).days + 1):
            day = first + timedelta(days=n)
            counts = [len({r[1] for r in own if r[1] is not None and day - timedelta(days=w) < r[2] <= day})
                      for w in widths.values()]
            expected.add((*([key] if keys else []), day, *counts))
    assert {tuple(r) for r in found.collect()} == expected


def test_trailing_users_of_no_rows(spark):
    df = spark.createDataFrame([(1, None)], "who long, d date")
    assert trailing_distinct(df, F.col("d"), "who", {"n": 7}).collect() == []
    one = spark.createDataFrame([(None, date(2024, 1, 1))], "who long, d date")
    assert [tuple(r) for r in trailing_distinct(one, F.col("d"), "who", {"n": 7}).collect()] == [
        (date(2024, 1, 1), 0)
    ]


# --- a query that lost rows


def test_likeness_keeps_parts_without_a_name(spark, tmp_path):
    schema = load(spark, "/root/testdata/sf0.001", "part").schema
    rows = [(1, None, "b", "STANDARD", 1, 1.0), (2, "standard", "b", None, 1, 1.0),
            (3, "standard", "b", "STANDARD", 1, 1.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "part.parquet"))
    found = REGISTRY["udf_scalar"].run(spark, str(tmp_path)).collect()
    assert {r["p_partkey"]: r["likeness"] for r in found} == {1: None, 2: None, 3: 1.0}


def test_more_slices_give_the_same_valleys(spark, sf_dir, con, monkeypatch):
    from quernstone.plans import activity

    monkeypatch.setattr(activity, "matches", lambda *a: matches(*a, rows_per_slice=50))
    df = REGISTRY["value_valleys"].run(spark, sf_dir)
    assert difference(df, con, REGISTRY["value_valleys"].sql) == ""
