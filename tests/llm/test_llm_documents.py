"""Operators 7 and 9 and the pipeline against plain Python."""

from __future__ import annotations

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from rows import documents, edge_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from quernstone.llm import mixing, near_duplicates  # noqa: E402
from quernstone.llm.common import written  # noqa: E402
from quernstone.llm.queries import QUERIES  # noqa: E402
from quernstone.sources import load  # noqa: E402


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - size + 1)
    return frozenset(b" ".join(words[i : i + size]) for i in range(n)) if words else frozenset()


def brute_components(rows, size, percent=80):
    """Smallest id reached, all pairs compared; rows of one id are one document."""
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i in root}


def test_buckets_with_repeated_ids_stay_apart(spark):
    members = {1: [1, 5, 5], 2: [1, 7, 7], 3: [2, 3], 4: [3, 2], 5: [9], 6: [1, 5, 7]}
    rows = [(d, k) for k, ids in members.items() for d in ids]
    got = near_duplicates._buckets(spark.createDataFrame(rows, "doc_id long, key long")).collect()
    assert sorted((r.key, r.n, r.leader) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 2, 2), (6, 3, 1)]


def check_near(spark, rows, size=4, **options):
    df = documents(spark, rows)
    got = near_duplicates.near_duplicates(df, size=size, **options).collect()
    of = brute_components([r[:2] for r in rows], size)
    expected = Counter(
        (i, len(shingle_set(t, size)), of.get(i), i is not None and of[i] == i)
        for i, t, *_ in rows
    )
    assert Counter(tuple(r) for r in got) == expected


def family(rng, n, length, first):
    """Copies of one text with a few words changed: pairs on both sides of the threshold."""
    vocabulary = [f"w{i}" for i in range(4_000)]
    base = rng.choices(vocabulary, k=length)
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        out.append((first + i, " ".join(words)))
    return out


def test_near_duplicates_of_a_large_family(spark):
    rng = random.Random(7)
    rows = family(rng, 150, 120, 1_000) + family(rng, 40, 60, 10)
    rows += [(5_000 + i, rows[0][1]) for i in range(60)]  # exact copies
    rows += [(6_000 + i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(40)]
    rng.shuffle(rows)
    check_near(spark, rows)
    check_near(spark, rows, block=16)  # groups in many blocks


def test_near_duplicates_edges(spark):
    check_near(spark, edge_rows() + [(70, "one two"), (71, "ONE\ttwo"), (72, "one two three"),
                                     (73, "ÉÉ two"), (74, "éé two")])
    # a repeated id has the links of both of its texts
    check_near(spark, [(5, "a b c d e"), (5, "f g h i j"), (9, "f g h i j"), (2, "a b c d e")])
    check_near(spark, [])


def test_near_duplicates_of_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: r.component_id for r in QUERIES["op7_circulant_minhash"](spark, sf_dir).collect()}
    assert got == brute_components(rows, 4)


def test_circulant_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 2**63, int(1000 * share), dtype="u8")
        sides = [np.concatenate([common, rng.integers(0, 2**63, 1000 - len(common), dtype="u8")])
                 for _ in range(2)]
        a, b = (near_duplicates.signature(s, 1024) for s in sides)
        assert np.mean(a == b) == pytest.approx(len(common) / (2000 - len(common)), abs=0.06)
    # a permutation: no two of many neighbours meet
    x = np.arange(1 << 18, dtype="u4")
    for made in (near_duplicates._permuted(x, near_duplicates._PI, (15, 12, 15)),
                 near_duplicates._permuted(x, near_duplicates._SIGMA, (16, 13, 16))):
        assert len(np.unique(made)) == len(x)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 202), (200, 202), (300, 300)]
    random.Random(2).shuffle(links)
    df = written(spark.createDataFrame(links, "a long, b long"), "chain")
    got = {r.doc_id: r.component for r in near_duplicates.components(df, "chain").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in (200, 201, 202)}


def test_deduplicated_goes_by_rows(spark):
    one, two = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, one), (1, two), (None, "no id at all here ever"), (None, "no id at all here ever"),
            (None, two), (2, one), (3, None), (3, None), (None, ""), (4, " ")]
    kept = near_duplicates.deduplicated(documents(spark, rows), size=5)
    assert kept.columns == documents(spark, rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, one), (1, two), (None, "no id at all here ever"), (3, None), (3, None),
                          (None, ""), (4, " ")], key=repr)
    assert near_duplicates.deduplicated(documents(spark, []), size=5).collect() == []


def test_deduplicated_keeps_one_of_each(spark):
    rows = edge_rows() + [(70, "one two"), (71, "ONE\ttwo")]
    df = documents(spark, rows)
    kept = near_duplicates.deduplicated(df, size=4)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 2, 3, None, 5, 7, 8, 9, -4, 70])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0, 1)), max_size=40), st.integers(0, 9))
def test_pivot_keeps_the_words(pairs, seed):
    size = np.array([s for s, _ in pairs], float)
    part = np.array([p for _, p in pairs], float)
    words = (size * part).sum()
    held = mixing.pivot(size, part, np.random.default_rng(seed).random(len(pairs)))
    assert (size * part).sum() == pytest.approx(words, abs=1e-6)
    open_ = np.flatnonzero((part > 0) & (part < 1))
    assert len(open_) <= 1 and (held in open_ or not len(open_))


def test_pivot_keeps_expectations():
    size, part = np.array([5.0, 1, 3, 9]), np.array([0.3, 0.5, 0.8, 0.1])
    total = np.zeros(4)
    for seed in range(6_000):
        p = part.copy()
        mixing.pivot(size, p, np.random.default_rng(seed).random(4))
        total += p
    assert total / 6_000 == pytest.approx(part, abs=0.03)


def expected_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - most * sum(sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def check_mix(rows, mixed):
    words = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += words(text)
    target = expected_targets(dict(sizes))
    assert Counter((m.id, m.source, m.size) for m in mixed) == Counter(
        (r[0], r[3], words(r[1])) for r in rows
    )
    taken, largest = defaultdict(int), defaultdict(int)
    for m in mixed:
        assert m.source_size == sizes[m.source]
        assert m.target == pytest.approx(target[m.source], rel=1e-9, abs=1e-9)
        assert m.taken == m.copies * m.size and 0 <= m.copies <= 3
        taken[m.source] += m.taken
        largest[m.source] = max(largest[m.source], m.size)
    for source, size in taken.items():
        assert abs(size - target[source]) <= largest[source] + 1e-6


def padded(rows):
    return [(*r, *[None] * (4 - len(r))) for r in rows]


@pytest.mark.parametrize("chunk", [2_048, 3])
def test_mixing_edges_and_reruns(spark, chunk):
    rng = random.Random(3)
    rows = padded(edge_rows()) + [
        (100 + i, " ".join(["w"] * rng.randint(1, 40)), "en", rng.choice(["a", "b", "é", "Z", "s1"]))
        for i in range(120)
    ]
    df = documents(spark, rows)
    first = mixing.mix(df, chunk=chunk).collect()
    check_mix(rows, first)
    again = mixing.mix(df.repartition(5).orderBy("n_chars", "text"), chunk=chunk).collect()
    assert Counter(first) == Counter(again)


def test_mixing_of_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text, None, r.source) for r in load(spark, sf_dir, "documents").collect()]
    check_mix(rows, mixing.mix(load(spark, sf_dir, "documents")).collect())


def test_mixing_nothing_and_empty_texts(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    rows = [(1, "", "en", "a"), (2, None, "en", None)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert {(m.id, m.size, m.target, m.taken) for m in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_mixed_documents_repeat_rows(spark):
    rows = padded(edge_rows()) + [(200 + i, "a b c " * (i % 9 + 1), "en", f"s{i % 4}") for i in range(60)]
    df = documents(spark, rows)
    plan = defaultdict(int)
    for m in mixing.mix(df).collect():
        plan[m.id, m.source, m.size] += m.copies
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    made = Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in out.collect())
    assert made == Counter({k: n for k, n in plan.items() if n})


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    before, good, distinct, masked, mixed, packed = (t.toPandas() for t in tables)
    for table in (good, distinct, masked, mixed):
        assert list(table.columns) == list(before.columns)
    labels = load(spark, sf_dir, "labels").toPandas().set_index("doc_id")
    clean = labels.index[labels.quality == 1]
    assert set(good.doc_id) <= set(before.doc_id)
    assert len(set(clean) - set(good.doc_id)) <= 0.03 * len(clean)
    of = brute_components(list(zip(good.doc_id, good.text, strict=True)), 5)
    assert sorted(distinct.doc_id) == sorted({c for c in of.values()})
    assert sorted(masked.doc_id) == sorted(distinct.doc_id)
    texts = dict(zip(distinct.doc_id, distinct.text, strict=True))
    from quernstone.llm.secrets import base_spans

    for r in masked.itertuples():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or "[SECRET]" in r.text
    copies = Counter(mixed.doc_id)
    assert max(copies.values()) <= 3 and set(mixed.text) <= set(masked.text)
    from test_llm_tokens import check_packing

    check_packing(list(zip(mixed.doc_id, mixed.text, strict=True)), list(packed.itertuples()))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
