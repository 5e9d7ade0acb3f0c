"""Operators 8 and 10 against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from compare import difference

from quernstone.llm import vectors
from quernstone.llm.queries import ORACLES, QUERIES
from quernstone.llm.vectors import exact_topk, nearest
from quernstone.sources import load

SCHEMA = "id long, v array<float>"
BAD = [(3, None), (4, []), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [float("inf"), 0.0]),
       (None, [1.0, 1.0])]


def brute(rows, queries, k, score):
    out = set()
    for qi, q in queries:
        found = sorted((-score(q, v), i) for i, v in rows if i != qi)[:k]
        out |= {(qi, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


def floors(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(floors(a), floors(b), strict=True))


def test_exact_topk_as_sql(spark, sf_dir, con):
    assert difference(QUERIES["op8_exact_topk"](spark, sf_dir), con, ORACLES["op8_exact_topk"]) == ""


@pytest.mark.parametrize("tile", [4, 10_000])
def test_exact_topk_ties_and_bad_vectors(spark, tile):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(2)]) for i in range(100, 180)]
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    queries = df.where("id % 10 = 0 OR id < 10 OR id IS NULL")
    got = {tuple(r) for r in exact_topk(df, queries, k=7, tile=tile).collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 7, product)


def test_exact_topk_merges_many_tiles(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in exact_topk(df, df.where("id < 5"), k=3, tile=5).collect()}
    assert got == brute(rows, rows[:5], 3, product)


def test_exact_topk_merges_at_the_registered_tile_size(spark):
    """40,000 rows are eight tiles of 5,000, merged four at a time; scores are made in blocks."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(40_000, 8)).astype("f4")
    v[::7] = v[3]  # ties between tiles
    df = spark.createDataFrame([(i, row) for i, row in enumerate(v.tolist())], SCHEMA)
    assert vectors._tile(df) == 5_000 and 40_000 // 5_000 > vectors.FAN_IN
    whole = np.floor(1024 * v.astype("f8"))
    expected = set()
    for query in range(0, 40_000, 100):
        scores = whole @ whole[query]
        scores[query] = -np.inf
        for n, i in enumerate(np.lexsort((np.arange(40_000), -scores))[:10], 1):
            expected.add((query, n, int(i), int(scores[i])))
    got = exact_topk(df, df.where("id % 100 = 0")).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_exact_topk_of_large_numbers_few_rows_and_none(spark):
    rows = [(1, [3e5, 1.0]), (2, [2.5e5, 3.0]), (3, [-3e5, 2.0])]  # beyond 2**53
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in exact_topk(df, df, k=10).collect()}
    assert got == brute(rows, rows, 10, product)
    repeated = exact_topk(df.unionAll(df), df, k=10).groupBy("query_id").count().collect()
    assert {r["count"] for r in repeated} == {4}
    huge = spark.createDataFrame([(1, [1e30]), (2, [-1e30])], SCHEMA)
    assert {r.score for r in exact_topk(huge, huge).collect()} == {-(2**63)}
    assert exact_topk(df.limit(0), df.limit(0)).collect() == []
    assert exact_topk(df.where("id = 1"), df.where("id = 1")).collect() == []
    with pytest.raises(ValueError):
        exact_topk(df.unionAll(spark.createDataFrame([(9, [1.0])], SCHEMA)), df).collect()


def cosine(a, b):
    a, b = np.asarray(a, "f4").astype("f8"), np.asarray(b, "f4").astype("f8")
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def test_nearest_recall_and_scores(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in load(spark, sf_dir, "embeddings").collect()}
    found = defaultdict(dict)
    for r in QUERIES["op10_nearest_vectors"](spark, sf_dir).collect():
        found[r.query_id][r.rank] = r
    hits = total = 0
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted((-cosine(vectors[q], v), i) for i, v in vectors.items() if i != q)[:5]
        got = [found[q][n] for n in range(1, 6)]
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
        for r in got:
            assert r.score == pytest.approx(cosine(vectors[q], vectors[r.vec_id]), abs=1e-12)
        hits += len({i for _, i in best} & {r.vec_id for r in got})
        total += 5
    assert hits >= 0.9 * total


def test_nearest_recall_without_the_least_number(spark):
    """Recall where the ascent stops early, and the same result however rows fall into tiles."""
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(40, 16))
    rows = [(i, (centers[i % 40] + rng.normal(0, 0.5, 16)).tolist()) for i in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = df.where("id % 100 = 0")
    results = [
        {tuple(r) for r in nearest(df, queries, share=0.3, least=1, tile=t).collect()}
        for t in (300, 10_000)
    ]
    assert results[0] == results[1]
    near = {(q, i) for q, _, i, _ in results[0]}
    hits = 0
    for q in range(0, 2_000, 100):
        best = sorted((-cosine(rows[q][1], v), i) for i, v in rows if i != q)[:5]
        hits += sum((q, i) in near for _, i in best)
    assert hits >= 0.9 * 100


def test_nearest_equal_vectors_and_bad_ones(spark):
    same = [(i, [1.0, 2.0]) for i in range(50, 90)]
    other = [(i, [float(i), 1.0]) for i in range(91, 95)]
    df = spark.createDataFrame(same + other + BAD + [(8, [0.0, 0.0])], SCHEMA)
    got = sorted(tuple(r) for r in nearest(df, df.where("id IN (50, 55, 89, 3, 8)")).collect())
    for q in (50, 55, 89):
        ids = [i for i in range(50, 90) if i != q][:5]
        assert [(n, i) for a, n, i, _ in got if a == q] == list(enumerate(ids, 1))
    assert {a for a, *_ in got} == {50, 55, 89}
    assert nearest(df.limit(0), df.limit(0)).collect() == []
    few = spark.createDataFrame(other[:3], SCHEMA)
    assert nearest(few, few.where("id = 91")).count() == 2


def test_a_repeated_row_does_not_hide_other_ids(spark):
    rows = [(1, [1.0, 0.0])] * 9 + [(i, [1.0, 0.0]) for i in (2, 3, 3, 4)] + [(5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = df.where("id = 1").distinct()
    got = nearest(df, asked, k=5)
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [
        (2, 1.0), (3, 1.0), (3, 1.0), (4, 1.0), (5, 0.0),
    ]
