"""Operator 11 against brute force, with texts whose smaller ids come later."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from compare import difference
from rows import documents, edge_rows

from quernstone.llm.filter_audit import COPY, audit_filters, merged_state
from quernstone.llm.queries import ORACLES, QUERIES

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
           "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """(part, set of failed filters, id) of every row, in plain Python."""
    least = {}
    for doc_id, text, _, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = set()
        if len(words) < 50:
            out.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            out.add("C")
        if re.search(r"[#$%&*|]", text):
            out.add("D")
        if doc_id is not None and doc_id > least[text]:
            out.add("E")
        yield source or "", out, doc_id


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for part, failing, doc_id in fails([(*r, None, None)[:4] for r in rows]):
        parts[part].append((failing, doc_id))
    out = set()
    for part, docs in parts.items():
        lines, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                earlier = sum(1 for d in docs if f in d[0]) - len(gone)
                alone = sum(1 for d in docs if d[0] == {f})
                shapley[f] += len(gone)
                lines.append((part, order, step, len(left), len(gone), earlier, alone,
                              sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone), f))
        out |= {(*line[:-1], shapley[line[-1]]) for line in lines}
    return out


def as_stream(spark, folder, files, **options):
    """Each list of rows as a file of its own, read one file per batch in this order."""
    for rows in files:
        documents(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def audited(spark, folder, files, labels, buckets=3):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit_filters(as_stream(spark, folder, files), marks, buckets)
    return {tuple(r[c] for c in COLUMNS) for r in found.select(*COLUMNS).collect()}


def test_matches_sql(spark, sf_dir, con):
    name = "op11_filter_audit"
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


def test_smaller_ids_that_come_later(spark, tmp_path):
    rng = random.Random(11)
    words = ["the", "of", "Stone", "mill", "GRAIN", "wheel|", "water", "race"]
    texts = [" ".join(rng.choices(words[:n], k=k)) for n in (4, 6, 8) for k in (3, 49, 50, 80)]
    rows = [(i, rng.choice(texts), "en", rng.choice(["s1", "s2", None, ""])) for i in range(120)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 120, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    rows.sort(reverse=True)
    files = [rows[:50], rows[50:90], rows[90:]]
    assert audited(spark, tmp_path / "d", files, labels) == brute(rows, labels)


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(r + (None,) * 4)[:4] for r in edge_rows()]
    rows += [(None, "no id here, none at all", "en", "s9"), (2**62, "x", "", "s9")]
    labels = [(5, 1, 1), (1, 1, 0)]
    files = [rows[6:], rows[:6]]
    assert audited(spark, tmp_path / "d", files, labels, buckets=1) == brute(rows, labels)


def test_one_text_with_a_third_of_all_rows(spark, tmp_path):
    rows = [(i, "copied " * 60 if i % 3 else f"own {i}", "en", f"s{i % 2}") for i in range(900, 0, -1)]
    files = [rows[:300], rows[300:600], rows[600:]]
    assert audited(spark, tmp_path / "d", files, [(1, 1, 1)]) == brute(rows, [(1, 1, 1)])


def test_no_documents_and_no_labels(spark, tmp_path):
    assert audited(spark, tmp_path / "d", [[]], []) == set()


@pytest.mark.parametrize("ids", [(9, 5, 7, 1), (1, 9), (3, 3, 2)])
def test_state_retracts(ids):
    """After any arrivals the changes sum to one original per text, all others copies."""
    columns = ["who", "id", "part", "bits", "n"]
    state, total = pd.DataFrame(columns=columns).astype({"id": "int64", "bits": "int32", "n": "int64"}), Counter()
    for i in ids:
        new = pd.DataFrame([(b"t", i, f"p{i}", 2, 1)], columns=columns)
        state, changes = merged_state(state, new)
        for part, bits, n in changes[["part", "bits", "n"]].itertuples(index=False):
            total[part, bits] += n
    expected = Counter((f"p{i}", 2 | (COPY if i > min(ids) else 0)) for i in ids)
    assert +total == expected and not -total
    assert set(state["id"]) == {min(ids)}
