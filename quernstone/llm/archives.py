"""Operator 12: web archives, and one capture history merged from their sorted runs.

Pages become WARC 1.1 records in files of bounded size, which Spark's text sink writes: a
record is a line, and the two empty lines that end a record are the line separator. A page whose
body was archived already becomes a ``revisit`` record without the body.

Reading goes by the lengths in the record headers, so bodies may contain anything. Every
reading task sorts the captures that it saw and writes them as a run. The runs are
merged outside memory: the key space (URL key, time, id) is cut into ranges of
about equal size, and the task of a range merges what the runs hold of it with a
loser tree. The ranges one after the other are the globally ordered history.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import row_ids, written
from quernstone.session import scratch

#: Bytes of one archive file, on average; a task reads whole files.
FILE_BYTES = 8_000_000
#: Captures that a reading task sorts as one run, and that a merging task holds.
RUN = 100_000
RANGE = 100_000
#: Bodies from this size on are archived once.
LEAST = 1_000
#: Parts that the rows of one repeated body are dealt to.
_SALTS = 16
_END = "\r\n\r\n"

ENTRY = (
    "urlkey string, captured string, id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, file string, offset long, length long"
)
_ARROW = [
    ("urlkey", pa.string()), ("captured", pa.string()), ("id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
    ("length", pa.int64()),
]


def _instant(seconds: Column) -> Column:
    """Seconds since 2024 as a WARC date, whatever the session's time zone."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    parts = [F.floor(seconds / 3_600) % 24, F.floor(seconds / 60) % 60, seconds % 60]
    clock = F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])
    return F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z"))


def _written_url(url: Column) -> Column:
    """The URL on one line: with white space or control characters in it, percent-encoded."""
    encoded = F.url_encode(url)
    for sign in "/:?&=#":
        encoded = F.replace(encoded, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.when(url.rlike(r"[\x00-\x20\x7f\x{85}\x{a0}]"), encoded).otherwise(url)


def _records(pages: DataFrame) -> Column:
    """One WARC record as text, without the two empty lines at its end."""
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    is_new = F.col("refers_to").isNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"), F.lit(_END),
    )
    block = F.octet_length(http) + F.when(is_new, F.col("n")).otherwise(0)
    url = F.when(
        F.length("url") > 0, F.concat(F.lit("WARC-Target-URI: "), _written_url(F.col("url")), F.lit("\r\n"))
    )
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_new, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Date: "), F.col("captured"),
        F.lit("\r\n"), F.coalesce(url, F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(is_new, "").otherwise(F.concat(
            F.lit(f"WARC-Profile: {profile}\r\nWARC-Refers-To: <urn:page:"),
            F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">\r\n"),
        )),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        block.cast("string"), F.lit(_END),
    )
    return F.concat(header, http, F.when(is_new, F.col("body")).otherwise(""))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
    body_col: str = "html", captured: Column | None = None, least: int = LEAST,
    file_bytes: int = FILE_BYTES, compression: str = "gzip",
) -> None:
    """Write one record per page below ``path``, in files of about ``file_bytes`` (before compression).

    Of pages with equal bodies of at least ``least`` bytes, that with the largest id is the
    response and the others revisit it; smaller bodies are always responses. Rows that
    share the largest id are all responses; a NULL id counts as smaller than any, and where
    all are NULL all are responses. A NULL body is empty. ``captured``: seconds since 2024-01-01
    (default: from the id, since pages carry no time; NULL: 0). A NULL or empty URL is left out of the record.
    Files are compressed whole, so offsets count uncompressed bytes; ``compression="none"`` makes
    files that can be read from any offset.
    An empty table writes no record.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    seconds = F.pmod(F.coalesce(captured if captured is not None else F.col(id_col), F.lit(0)).cast("long"),
                     F.lit(10**9))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        body.alias("body"), _instant(seconds).alias("captured"),
    )
    rows = rows.withColumns({"n": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    # two digests and the length: equal bodies, also where someone made SHA-1 collide
    same = F.concat_ws(":", "digest", F.xxhash64("body"), "n")
    rows = rows.withColumn("same", F.when(F.col("n") >= least, same))
    keys = written(rows.select("id", "same", "n"), "page-bodies")
    sizes = keys.agg(F.count("*"), F.sum("n")).first()
    heads = (
        keys.where("same IS NOT NULL").groupBy("same")
        .agg(F.max("id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
        .select("same", "last", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    )
    # a body's rows go to several parts; rows that need no head are spread over all
    spread = F.xxhash64("id", "url", F.monotonically_increasing_id())
    rows = rows.withColumns(
        {
            "salt": F.pmod(spread, F.lit(_SALTS)).cast("int"),
            "same": F.coalesce("same", F.concat(F.lit("-"), spread.cast("string"))),
        }
    ).join(heads, ["same", "salt"], "left")
    newer = F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last")))
    rows = rows.withColumn("refers_to", F.when(newer, F.col("last")))
    average = (sizes[1] or 0) / max(1, sizes[0]) + 500
    (
        rows.select(_records(rows).alias("value")).write
        .option("lineSep", _END).option("maxRecordsPerFile", max(1, int(file_bytes / average)))
        .option("compression", compression).text(path)
    )


class Archive:
    """The records of one archive file's bytes."""

    _line = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")

    def __init__(self, data: bytes):
        self.data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data

    def __iter__(self) -> Iterator[tuple[int, int, dict, int, int]]:
        """Offset, length, header fields, and where the block begins and ends."""
        at, data = 0, self.data
        while at < len(data):
            stop = data.find(b"\r\n\r\n", at)
            if stop < 0 or not data.startswith(b"WARC/", at):
                raise ValueError(f"no record at byte {at}")
            head = dict(self.fields(at, stop))
            begin = stop + 4
            end = begin + int(head["content-length"])
            if data[end : end + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at} is cut short")
            yield at, end + 4 - at, head, begin, end
            at = end + 4

    def fields(self, at: int, stop: int) -> Iterator[tuple[str, str]]:
        for name, value in self._line.findall(self.data, at, stop):
            yield name.decode().strip().lower(), value.decode("utf-8", "replace").strip()

    def body(self, begin: int, end: int) -> tuple[dict, bytes]:
        """HTTP header fields and payload of a block."""
        stop = self.data.find(b"\r\n\r\n", begin, end)
        if stop < 0:
            raise ValueError(f"no HTTP header at byte {begin}")
        return dict(self.fields(begin, stop)), self.data[stop + 4 : end]


def url_key(url: str | None) -> str:
    """A URL's sort key: host names from the right, no scheme, ``www``, port, fragment; lower case.

    Arguments are sorted. NULL and empty URLs have the empty key; what has no host is
    its own key.
    """
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").strip(".")
    except ValueError:  # such as an open bracket in the host
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path.rstrip("/") or "/")
    return (key + (f"?{query}" if query else "")).lower()


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def _entries(file: str, data: bytes) -> Iterator[tuple]:
    """The captures of a file, as ``ENTRY``. A payload that does not have its digest is an error."""
    archive = Archive(data)
    for offset, length, head, begin, end in archive:
        kind = head.get("warc-type", "")
        if kind not in ("response", "revisit"):
            continue
        http, payload = archive.body(begin, end)
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        size = int(http["content-length"])
        if kind == "response":
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{file}: the payload at byte {offset} does not have its digest")
        url = head.get("warc-target-uri")
        captured = re.sub(r"\D", "", head["warc-date"])[:14]
        yield (url_key(url), captured, _page(head["warc-record-id"]), url, kind, size, digest,
               _page(head.get("warc-refers-to", "")), file, offset, length)


def _order(e: tuple) -> tuple:
    """URL key, time, id (NULL first), then the place, which no two captures share."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[8], e[9]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def sorted_runs(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """The captures of all archives below ``path``: each run of a task sorted, with ``run, nth``."""
    schema = pa.schema([("run", pa.int64()), ("nth", pa.int64()), *_ARROW])

    def read(batches):
        number, held = row_ids(), []

        def done():
            held.sort(key=_order)
            n = next(number)
            for at in range(0, len(held), 10_000):
                part = held[at : at + 10_000]
                yield _batch([(n, at + i, *e) for i, e in enumerate(part)], schema)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for entry in _entries(file, data):
                    held.append(entry)
                    if len(held) == run:
                        yield from done()
        if held:
            yield from done()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, f"run long, nth long, {ENTRY}")


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the root the winner.

    After the winner leaves, its list's next entry plays only against the losers on its
    own way up: one comparison a level.
    """

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at = lists, [0] * len(lists)
        k = len(lists)
        self.keys = [_order(entries[0]) if entries else None for entries in lists]
        self.loser = [-1] * max(1, k)  # node 0: the overall winner
        for i in range(k):
            self._play(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether list ``a``'s entry comes before ``b``'s; an empty list comes last."""
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and x < y)

    def _play(self, i: int, building: bool = False) -> None:
        node, winner = (i + len(self.lists)) // 2, i
        while node:
            other = self.loser[node]
            if other < 0 and building:  # the first to come waits for its opponent
                self.loser[node] = winner
                return
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.lists:
            i = self.loser[0]
            if self.keys[i] is None:
                return
            entries, at = self.lists[i], self.at[i]
            yield entries[at]
            at += 1
            self.at[i] = at
            self.keys[i] = _order(entries[at]) if at < len(entries) else None
            self._play(i)


def merged_histories(runs: DataFrame, rows: int = RANGE) -> DataFrame:
    """The runs in one order: ``ENTRY``, ``part`` (rising with the order), ``place`` and ``capture_no``.

    ``place`` counts within a part; ``capture_no`` numbers the captures of a URL key by time, over
    all parts. A URL with very many captures lies in several parts, as the cuts are made by URL
    key, time, id and place in the archives. No rows give no rows.
    """
    spark = runs.sparkSession
    schema = pa.schema([*_ARROW, ("place", pa.int64()), ("nth_here", pa.int64())])
    ours = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(ours, -(-runs.count() // rows))

    def merge(batches):
        # the rows of a run arrive together, though perhaps in several batches
        segments: dict[int, list[tuple]] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for number, nth, *entry in zip(*columns, strict=True):
                segments.setdefault(number, []).append((nth, tuple(entry)))
        lists = []
        for segment in segments.values():
            if any(a[0] > b[0] for a, b in zip(segment, segment[1:], strict=False)):
                segment.sort()
            lists.append([entry for _, entry in segment])
        out, last, nth = [], None, 0
        for place, entry in enumerate(LoserTree(lists)):
            nth = nth + 1 if entry[0] == last else 1
            last = entry[0]
            out.append((*entry, place, nth))
            if len(out) == 10_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    dealt = runs.repartitionByRange(n, "urlkey", "captured", "id", "file", "offset")
    merged = written(
        dealt.mapInArrow(merge, f"{ENTRY}, place long, nth_here long").withColumn(
            "part", F.spark_partition_id()
        ),
        "histories",
    )
    # a key that goes on from earlier parts counts on from what they hold of it
    ends = merged.groupBy("part").agg(
        F.min("urlkey").alias("first"), F.max(F.struct("urlkey", "nth_here")).alias("last")
    )
    edges = ends.select("part", F.col("last.urlkey").alias("urlkey"), F.col("last.nth_here").alias("n"))
    opens = ends.select("part", F.col("first").alias("urlkey"), F.lit(0).cast("long").alias("n"))
    before = Window.partitionBy("urlkey").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    counted = (
        edges.unionAll(opens).withColumn("before", F.sum("n").over(before))
        .where("before > 0").groupBy("part", "urlkey").agg(F.max("before").alias("before"))
    )
    number = F.col("nth_here") + F.coalesce("before", F.lit(0).cast("long"))
    return (
        merged.join(counted, ["part", "urlkey"], "left")
        .withColumn("capture_no", number).drop("nth_here", "before")
    )


def archive_pages(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their captures (see the parts above).

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and ``urlkey, captured,
    capture_no`` of the history: one row per page, as read from the archives. The size and
    digest of a response are those of the payload found there, those of a revisit stand in
    its headers. Other columns of ``pages`` play no part.
    """
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path, id_col, **options)
    runs = written(sorted_runs(spark, path), "capture-runs")
    merged = merged_histories(runs)
    return merged.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", "refers_to", "urlkey", "captured", "capture_no",
    )
