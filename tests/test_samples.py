"""Weighted samples: shares against their probabilities, reruns, rows that can't be drawn."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quernstone.operators import weighted_sample


def test_rows_are_drawn_in_proportion_to_weight(spark):
    """20,000 strata of weights 1, 2, 3: the first draw takes them in sixths, the second what is left."""
    rows = spark.range(60_000).selectExpr("id DIV 3 AS s", "id", "id % 3 + 1 AS w")
    drawn = weighted_sample(rows, ["s"], "id", "w", 2).collect()
    assert len(drawn) == 40_000 and len({(r["s"], r["id"]) for r in drawn}) == 40_000
    first = Counter(r["w"] for r in drawn if r["rank"] == 1)
    second = Counter(r["w"] for r in drawn if r["rank"] == 2)
    for w in (1, 2, 3):
        p1 = w / 6
        p2 = sum(v / 6 * w / (6 - v) for v in (1, 2, 3) if v != w)
        for n, p in ((first[w], p1), (second[w], p2)):
            assert abs(n - 20_000 * p) <= 4 * (20_000 * p * (1 - p)) ** 0.5


def test_sample_does_not_depend_on_partitions_and_survives_a_hot_stratum(spark):
    rows = spark.range(30_000).selectExpr(
        "IF(id % 3 > 0, 'hot', IF(id % 5 = 0, NULL, concat('s', id % 7))) AS s", "id", "id % 11 + 0.5D AS w"
    )
    once = weighted_sample(rows, ["s"], "id", "w", 50).collect()
    again = weighted_sample(rows.repartition(23, "w"), ["s"], "id", "w", 50).collect()
    other = weighted_sample(rows, ["s"], "id", "w", 50, seed=2).collect()
    assert sorted(once, key=repr) == sorted(again, key=repr) != sorted(other, key=repr)
    assert Counter(r["s"] for r in once) == dict.fromkeys([None, "hot", *[f"s{i}" for i in range(7)]], 50)


def test_rows_without_weight_or_id_are_never_drawn(spark):
    bad = [("a", 1, None), ("a", 2, 0.0), ("a", 3, -1.0), ("a", 4, float("nan")), ("a", 5, float("inf")),
           ("a", None, 1.0)]
    df = spark.createDataFrame([*bad, ("a", 6, 2.0), ("b", 7, 1e-300)], "s string, id long, w double")
    found = weighted_sample(df, ["s"], "id", "w", 5).collect()
    assert sorted((r["s"], r["id"], r["rank"]) for r in found) == [("a", 6, 1), ("b", 7, 1)]
    assert weighted_sample(df.limit(0), ["s"], "id", "w", 5).collect() == []


def test_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(0, 1_000, 1, 4).withColumn("s", F.col("id") % 3).withColumn("w", F.lit(1.0))
    plan = weighted_sample(df, ["s"], "id", "w", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit") and plan.count("WindowGroupLimit") == 2
