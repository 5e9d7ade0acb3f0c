"""Operator 12: records written, read back, and merged into one order."""

from __future__ import annotations

import hashlib
import random

import pytest
from compare import difference

from quernstone.llm.archives import (
    Archive,
    LoserTree,
    _order,
    archive_pages,
    merged_histories,
    sorted_runs,
    url_key,
    write_archives,
)
from quernstone.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string, id string, n int, body string, same string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def edge_pages():
    long = "é<p>text</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
    return [
        (1, "http://a.example/1", long), (2, "http://a.example/1", long), (9, None, long),
        (None, "http://a.example/1", long), (3, "", None), (4, "http://b.example/x y\nz", ""),
        (5, "http://b.example/", "x" * 999), (6, "http://b.example/", "x" * 999),
        (7, "http://www.b.example:80/?b=2&a=1#f", "y" * 1000), (-8, "nonsense", "y" * 1000),
        (10, "http://[bad", "é" * 500), (10, "http://[bad", "é" * 500), (11, "http://c.example", "é" * 500),
        (12, "http://c.example/漢字", "\r\n\r\n"), (13, "http://c.example", "z" * 300_000),
    ]


def brute(rows):
    last = {}
    for i, _, body in rows:
        data = (body or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, _, body in rows:
        data = (body or "").encode()
        head = last.get(data)
        revisit = head is not None and (i is None or i < head)
        kind = "revisit" if revisit else "response"
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, head if revisit else None))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_matches_sql(spark, sf_dir, con):
    name = "op12_capture_histories"
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_edge_pages(spark, compression):
    rows = edge_pages()
    df = pages(spark, rows).repartition(3)
    assert result(archive_pages(df, compression=compression, file_bytes=5_000)) == brute(rows)


def test_no_pages(spark):
    assert archive_pages(pages(spark, [])).collect() == []


def test_one_body_with_a_third_of_all_rows(spark):
    rows = [(i, f"http://h.example/{i % 7}", "same " * 300 if i % 3 == 0 else f"{i} " * 300)
            for i in range(600)]
    assert result(archive_pages(pages(spark, rows).repartition(4))) == brute(rows)


def test_files_are_warc_and_offsets_point_at_records(spark, tmp_path):
    rows = edge_pages()
    path = str(tmp_path / "archives")
    write_archives(pages(spark, rows), path, file_bytes=3_000, compression="none")
    files = {str(f): f.read_bytes() for f in (tmp_path / "archives").glob("part-*")}
    assert len(files) > 1
    runs = sorted_runs(spark, path).collect()
    assert len(runs) == len(rows)
    bodies = {(i, b or "") for i, _, b in rows}
    for r in runs:
        data = files[r["file"].removeprefix("file:")][r["offset"] : r["offset"] + r["length"]]
        ((at, length, head, begin, end),) = list(Archive(data))
        http, payload = Archive(data).body(begin, end)
        assert (at, length) == (0, len(data)) and int(http["content-length"]) == r["payload_bytes"]
        if r["record_type"] == "response":
            assert (r["id"], payload.decode()) in bodies
        else:
            assert payload == b"" and head["warc-refers-to"] == f"<urn:page:{r['refers_to']}>"


def test_changed_payload_is_noticed(spark, tmp_path):
    path = tmp_path / "archives"
    write_archives(pages(spark, [(1, "http://a.example", "q" * 2000)]), str(path), compression="none")
    (file,) = [f for f in path.glob("part-*") if f.stat().st_size]
    (tmp_path / "changed").mkdir()
    (tmp_path / "changed" / "a.warc").write_bytes(file.read_bytes().replace(b"qq", b"qr", 1))
    with pytest.raises(Exception, match="does not have its digest"):
        sorted_runs(spark, str(tmp_path / "changed")).collect()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(file.read_bytes()[:-10])
    with pytest.raises(Exception, match="cut short"):
        sorted_runs(spark, str(tmp_path / "cut")).collect()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    lists = []
    for i in range(k):
        keys = sorted((rng.choice("abc"), rng.choice("12")) for _ in range(rng.choice([0, 1, 9])))
        lists.append(sorted(
            ((a, t, rng.choice([None, 1]), None, "", 0, "", None, f"f{i}", n, 0)
             for n, (a, t) in enumerate(keys)), key=_order))
    merged = list(LoserTree(lists))
    assert merged == sorted((e for part in lists for e in part), key=_order)


def test_histories_are_in_global_order(spark, tmp_path):
    """One URL with most captures runs through many parts; its captures are numbered through."""
    rng = random.Random(12)
    rows = [(i, "http://hot.example/" if i % 3 else f"http://x.example/{rng.randrange(40)}", f"{i}")
            for i in range(900)]
    path = str(tmp_path / "archives")
    write_archives(pages(spark, rows).repartition(5), path, file_bytes=20_000)
    found = merged_histories(sorted_runs(spark, path, run=50), rows=60)
    got = sorted(found.collect(), key=lambda r: (r["part"], r["place"]))
    keys = [(r["urlkey"], r["captured"], r["id"]) for r in got]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert len({r["part"] for r in got if r["urlkey"] == "example,hot)/"}) > 3
    seen = {}
    for r in got:
        seen[r["urlkey"]] = seen.get(r["urlkey"], 0) + 1
        assert r["capture_no"] == seen[r["urlkey"]]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.b.example:80/A/?b=2&a=1#f", "example,b)/a?a=1&b=2"),
        ("https://b.example", "example,b)/"), ("HTTP://B.example/", "example,b)/"),
        (None, ""), ("", ""), ("nonsense", "nonsense"), ("http://[bad", "http://[bad"),
    ],
)
def test_url_key(url, key):
    assert url_key(url) == key
