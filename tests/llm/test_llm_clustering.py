"""Operator 13 against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from compare import difference

from quernstone.llm.clustering import added, cluster_vectors, narrow, partial_distances, whole
from quernstone.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, cluster string, batch int, id int, v int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
MOST = 2**63 - 1


def brute(rows, size, k, rounds=3, scale=64):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == size
            and all(x is not None and math.isfinite(x) for x in v)]

    def rank(r):
        i, v = r
        return (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v)

    centers = [v for _, v in sorted(kept, key=rank)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            centers[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(
        (
            (i, n, min(d, MOST), min(sum(e for _, e, m in found if m == n), MOST), min(total, MOST),
             hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest())
            for i, d, n in found
        ),
        key=repr,
    )


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster_vectors(df, **options).select(*COLUMNS).collect()), key=repr)


def test_matches_sql(spark, sf_dir, con):
    name = "op13_sharded_lloyd"
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_random_vectors_and_bad_ones(spark, shards):
    rng = random.Random(13)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(5)]) for i in range(150)]
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0] * 4 + [None]),
             (904, [1.0] * 4 + [float("nan")]), (905, [float("inf")] * 5), (None, [2.0] * 5)]
    got = result(spark, rows, size=5, k=6, shards=shards, batch=16)
    assert got == brute(rows, 5, 6)


def test_ties_repeats_and_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.5, 0.5]), (None, [0.5, 0.5]), (2, [0.25, 0.5])]
    assert result(spark, rows, size=2, k=16) == brute(rows, 2, 16)
    square = [(i, [float(i % 2), float(i // 2 % 2)]) for i in range(40)]
    assert result(spark, square, size=2, k=3, batch=7) == brute(square, 2, 3)


def test_a_third_of_all_vectors_alike(spark):
    rng = random.Random(14)
    rows = [(i, [0.5, -0.5, 0.25] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)])
            for i in range(300)]
    assert result(spark, rows, size=3, k=8, shards=2, batch=20) == brute(rows, 3, 8)


def test_very_large_components(spark):
    rng = random.Random(15)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 9, 18, 30, 307]) for _ in range(3)])
            for i in range(40)]
    rows.append((99, [1.7e308, -1.7e308, 5e-324]))
    assert result(spark, rows, size=3, k=4, shards=2, batch=8) == brute(rows, 3, 4)


def test_no_vectors(spark):
    assert result(spark, [(1, None), (2, [1.0])]) == []


def test_exact_integers():
    x = whole(np.array([[0.1, -0.1, 2.0**60, 1e308]]), 64.0)
    assert x.tolist() == [[6, -7, 2**66, int(1e308) * 64]]
    assert narrow(np.array([-5, 200])).dtype == np.int16
    assert added(np.array([200], "u1"), np.array([2**63 - 1])).tolist() == [2**63 + 199]
    a, b = np.array([[2**40, -3]], "i8"), np.array([[-(2**40), 3], [0, 0]], "i8")
    assert partial_distances(a, b).tolist() == [[2**82 + 36, 2**80 + 9]]
