"""Operators 2, 4 and 6 against the tokenizer library itself."""

from __future__ import annotations

import random
import sys
import tempfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from rows import documents, edge_rows  # noqa: E402

from quernstone.llm import packing, token_counts, token_matrices  # noqa: E402
from quernstone.llm.queries import QUERIES  # noqa: E402
from quernstone.llm.tokens import WORD_BPE, words_of  # noqa: E402
from quernstone.sources import load  # noqa: E402


def library_ids(text):
    return words_of(WORD_BPE).library.encode(text or "", add_special_tokens=False).ids


ALPHABET = "abcdeéÉ ’'strvlm<|endoftxt>12!?.́̂\n\t\x1c\x85Σa한ᅡᆨ漢🎉ßſKİ  "


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=14))
def test_every_prefix_as_the_library_counts_it(text):
    deltas = token_counts.prefixes_of(WORD_BPE).deltas([text])[0]
    counts = np.cumsum(np.frombuffer(deltas, "<i2"))
    assert counts.tolist() == [len(library_ids(text[:i])) for i in range(1, len(text) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_ids_as_the_library_gives_them(text):
    assert np.frombuffer(words_of(WORD_BPE).ids(text), "<u4").tolist() == library_ids(text)


def test_special_strings_and_contractions():
    solver = token_counts.prefixes_of(WORD_BPE)
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "!<|endoftext|>!", "<|endoftex",
                 "it's they're 'r 're 'rex x'll don't", "a" * 70, "각 각 각",
                 "'s\u0301 'r 're\u0301 !'t\u0301 ''ve\u0301x a's\u0327\u0301", "สวัสดีครับ กำลัง"):
        counts = np.cumsum(np.frombuffer(solver.deltas([text])[0], "<i2"))
        assert counts.tolist() == [len(library_ids(text[:i])) for i in range(1, len(text) + 1)], text


def test_token_counts_of_tables(spark, sf_dir):
    docs = {d.doc_id: d.text for d in load(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(library_ids(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 2048)


def test_token_count_edges(spark):
    from pyspark.sql import functions as F

    counted = token_counts.prefix_counts(documents(spark, edge_rows()))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counted.collect()) == Counter(
        (r[0], len((r[1] or "").encode()), len(library_ids(r[1]))) for r in edge_rows()
    )
    assert token_counts.prefix_counts(documents(spark, [])).collect() == []
    text = "One. Two! <|endoftext|> it's"
    asked = counted.where("doc_id = 9").select(
        *[token_counts.tokens_at("deltas", F.lit(n)).alias(f"at{n}") for n in (0, 5, 12, 99)],
        *[token_counts.longest_within("deltas", F.lit(n)).alias(f"in{n}") for n in (0, 3, 99)],
    ).first()
    assert asked[:4] == tuple(len(library_ids(text[:n])) for n in (0, 5, 12, 99))
    fits = lambda n: max(i for i in range(len(text) + 1) if len(library_ids(text[:i])) <= n)
    assert asked[4:] == (fits(0), fits(3), fits(99))


def check_packing(rows, pieces, capacity=2048):
    """Every id of every document once, pieces right, sequences gapless; returns the sequences."""
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*library_ids(text), 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == expected
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        full = 0
        for offset, length in sorted(parts):
            assert offset == full
            full += length
        assert full <= capacity
    return sequences


def test_packing_of_tables(spark, sf_dir):
    rows = [(d.doc_id, d.text) for d in load(spark, sf_dir, "documents").collect()]
    pieces = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    sequences = check_packing(rows, pieces)
    assert len(sequences) <= -(-sum(p.length for p in pieces) // 2048) + 1


def test_packing_edges_and_several_islands(spark):
    docs = documents(spark, edge_rows() * 3)
    check_packing(edge_rows() * 3, packing.pack_documents(docs).collect())
    assert packing.pack_documents(documents(spark, [])).collect() == []
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(600)]
    rows = [(i, i % 7, 0, 0, n, 0) for i, n in enumerate(lengths)]
    table = spark.createDataFrame(rows, "row long, doc_id long, piece int, start long, length long, "
                                        "ids_crc32 long")  # fmt: skip
    from quernstone.llm.common import written

    packed = packing.pack_pieces(written(table, "pieces"), capacity=100, island=60).collect()
    bins = Counter()
    for p in packed:
        bins[p.sequence_id] += p.length
    assert max(bins.values()) <= 100 and sum(bins.values()) == sum(lengths)
    assert sorted(p.row for p in packed) == list(range(600))
    assert len(bins) <= -(-sum(lengths) // 100) * 1.06


def test_genetic_packing_beats_plain_best_fit():
    # triples that fill a bin exactly; best fit decreasing misses many of them
    rng = np.random.default_rng(5)
    size = []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(255, 1000 - a - 255))
        size += [a, b, 1000 - a - b]
    size.sort(reverse=True)
    plain = packing.Bins(1000)
    plain.best_fit(range(len(size)), size)
    best = packing.evolve(size, 1000, seed=1, generations=150)
    assert sorted(i for b in best.bins for i in b) == list(range(len(size)))
    assert all(sum(size[i] for i in b) + r == 1000 for b, r in zip(best.bins, best.room, strict=True))
    assert packing._fitness(best) > packing._fitness(plain)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_segment_tree_is_best_fit_decreasing(lengths):
    rows = token_matrices.best_fit_decreasing(lengths, 50)
    rooms, expected = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(50 - lengths[i])
    expected = sorted(rooms)
    assert sorted(50 - sum(lengths[i] for i in r) for r in rows) == expected
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


@pytest.mark.parametrize("gathered", [500, 1_000_000])
def test_matrices_round_trip(spark, sf_dir, gathered):
    rows = [(d.doc_id, d.text) for d in load(spark, sf_dir, "documents").limit(300).collect()]
    rows += [r[:2] for r in edge_rows()]
    made = token_matrices.token_matrices(
        documents(spark, rows), capacity=128, gathered=gathered, matrix_rows=8
    )
    path = tempfile.mkdtemp(prefix="matrices-") + "/m"
    token_matrices.write_matrices(made, path)
    parts = defaultdict(dict)
    counted = Counter()
    for s in token_matrices.read_segments(spark, path).collect():
        parts[s.doc_id].setdefault(s.start, []).append(bytes(s.ids))
        counted[s.doc_id, s.start] += 1
    for doc_id, text in rows:
        ids = np.array([*library_ids(text), 0], "<u4")
        for start in range(0, len(ids), 128):
            assert ids[start : start + 128].tobytes() in parts[doc_id][start]
    assert sum(counted.values()) == sum(-(-(len(library_ids(t)) + 1) // 128) for _, t in rows)
    for m in spark.read.parquet(path).collect():
        assert len(m.ids) == 4 * 128 * m.n_rows and m.cu_seqlens[0] == 0
        assert len(m.doc_ids) == len(m.cu_seqlens) - 1 and set(range(0, 128 * m.n_rows, 128)) <= set(m.resets)
    assert token_matrices.token_matrices(documents(spark, [])).collect() == []
