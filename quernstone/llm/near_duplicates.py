"""Operator 7: near-duplicates by circulant MinHash, with exact confirmation.

Every signature coordinate is the minimum of one permutation of the shingles' hashes.
Here two permutations make them all: the first scatters the hashes, the second is
shifted by k, circularly, for coordinate k. Documents that agree in a band of
coordinates meet in a bucket.

Texts with equal shingle sets are one class, of which only the smallest doc_id goes
on. In each bucket the members are first compared with one leader. That leaves few
buckets whose members are not yet connected; in these, all members of different
components are compared, in blocks of bounded size, and only links that connect
components leave the task. Links are confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import unused, written

BANDS, ROWS = 32, 4
#: Documents of a group that one task compares.
BLOCK = 512
#: Places of the filter that spares texts without candidates the shuffle (2 MB when broadcast).
_FILTER = 1 << 23
_KEPT_WORDS = 100_000
_U32, _U64 = np.uint32, np.uint64
#: Odd multipliers that scatter bits well, and the seeds of the word hash.
_MIX64 = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_SIGMA, _PI = (0x85EBCA6B, 0xC2B2AE35), (0x7FEB352D, 0x846CA68B)
_PLACES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
           0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)

_hashes: dict[bytes, int] = {}


def _scatter64(x: np.ndarray) -> np.ndarray:
    for m in _MIX64:
        x = x ^ (x >> _U64(33))
        x = x * _U64(m)
    return x ^ (x >> _U64(33))


def _permuted(x: np.ndarray, multipliers: tuple[int, int], shifts: tuple[int, int, int]) -> np.ndarray:
    """A permutation of the 32-bit numbers: odd multiples and shifted sums can be undone."""
    a, b, c = shifts
    x = x ^ (x >> _U32(a))
    x *= _U32(multipliers[0])
    x ^= x >> _U32(b)
    x *= _U32(multipliers[1])
    x ^= x >> _U32(c)
    return x


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words as sorted 64-bit hashes.

    A-Z count as lower case; words are what ASCII white space separates. Fewer words
    make one shingle, none make none.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, _U64)
    if len(_hashes) > _KEPT_WORDS:
        _hashes.clear()
    digest = xxhash.xxh3_64_intdigest
    found = list(map(_hashes.get, words))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = _hashes[words[i]] = digest(words[i])
    h = np.array(found, _U64)
    width = min(size, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, width, _U64)
    for k in range(width):
        mixed += _scatter64(h[k : k + n] * _U64(_PLACES[k % 8]) + _U64(k))
        mixed *= _U64(_PLACES[(k + 3) % 8])
    return np.unique(_scatter64(mixed))


def signature(shingle_hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: ``min over x of pi((sigma(x) + k) mod 2**32)`` for k from 0."""
    x = (shingle_hashes >> _U64(32)).astype(_U32)
    x = _permuted(x, _SIGMA, (16, 13, 16))
    out = np.empty(coordinates, _U32)
    step = max(1, (1 << 16) // len(x))  # some coordinates at once, as fits the cache
    for k in range(0, coordinates, step):
        shifts = np.arange(k, min(k + step, coordinates), dtype=_U32)
        out[k : k + step] = _permuted(x[None] + shifts[:, None], _PI, (15, 12, 15)).min(axis=1)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; equal parts in different bands give different keys."""
    parts = sig.reshape(bands, -1).astype(_U64)
    keys = np.arange(1, bands + 1, dtype=_U64) * _U64(_PLACES[0])
    for column in parts.T:
        keys = _scatter64(keys ^ (column * _U64(_PLACES[1]) + _U64(_PLACES[2])))
    return keys.astype("i8")


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, same, bands`` of ``doc_id, text`` (binary); ``same``: equal sets only."""
    schema = "doc_id long, n_shingles long, same binary, bands array<long>"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()),
                       ("bands", pa.list_(pa.int64()))])

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, size)
                if len(s):
                    same = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
                    keys = band_keys(signature(s, bands * rows), bands)
                    out.append((doc_id, len(s), same, keys.tolist()))
                else:
                    out.append((doc_id, 0, None, []))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _with_leader(size: int, percent: int):
    """Links of a leader with the members of one part of its group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, size) for t in pdf["text"]]
        ids, leads = pdf["doc_id"].to_numpy("i8"), pdf["leads"].to_numpy(bool)
        leaders = [sets[i] for i in np.flatnonzero(leads)]
        linked = [ids[i] for i in np.flatnonzero(~leads)
                  if any(similar(s, sets[i], percent) for s in leaders)]
        return pd.DataFrame({"a": np.full(len(linked), key[0], "i8"), "b": np.array(linked, "i8")})

    return run


def connecting_links(ids, components, sets, sides, percent: int) -> list[tuple[int, int]]:
    """Links of similar sets that connect components, none more than needed for that.

    ``sides``: pairs between side 0 and side 1 count, or all if there is one side. Intersections
    come from a product of the sets' membership matrices over the shingles that
    occur at least twice, in slices of bounded size.
    """
    n = len(sets)
    lengths = np.array([len(s) for s in sets], "i8")
    everything = np.concatenate(sets) if n else np.empty(0, _U64)
    distinct, column, times = np.unique(everything, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(distinct), -1, "i8")
    place[shared] = np.arange(len(shared))
    owner, column = np.repeat(np.arange(n), lengths), place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), "f4")
    width = max(1, 4_000_000 // max(1, n))
    for start in range(0, len(shared), width):
        low, high = np.searchsorted(column, [start, start + width])
        member = np.zeros((n, width), "f4")
        member[owner[low:high], column[low:high] - start] = 1
        both += member @ member.T
    close = 100 * both >= percent * (lengths[:, None] + lengths[None] - both)
    close &= np.not_equal.outer(components, components)
    if len(set(sides)) > 1:
        close &= np.not_equal.outer(sides, sides)
    root = {c: c for c in components}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        a, b = top(components[i]), top(components[j])
        if a != b:
            root[a] = b
            links.append((ids[i], ids[j]))
    return links


def _in_block(size: int, percent: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # shingles only where something can be linked
        component = pdf["component"].to_numpy("i8")
        if len(pdf) < 2 or (component == component[0]).all():
            return pd.DataFrame({"a": [], "b": []}, dtype="i8")
        sets = [shingles(t, size) for t in pdf["text"]]
        links = connecting_links(
            pdf["doc_id"].tolist(), component.tolist(), sets, pdf["side"].to_numpy(), percent
        )
        return pd.DataFrame(links, columns=["a", "b"], dtype="i8")

    return run


def components(links: DataFrame, label: str) -> DataFrame:
    """``doc_id, component`` of every end of ``links`` (``a, b``): the smallest id it reaches.

    Each round takes the smallest label around and then the label of that label, until
    nothing changes; every round is a written table. No node's links are gathered.
    """
    both = written(
        links.select("a", "b").unionAll(links.select("b", "a")).where("a <> b").distinct(),
        f"{label}-links",
    )
    labels = written(
        both.groupBy(F.col("a").alias("doc_id")).agg(
            F.least(F.min("b"), F.col("doc_id")).alias("component")
        ),
        f"{label}-labels",
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("doc_id", "b"), "b")
            .groupBy(F.col("a").alias("doc_id"))
            .agg(F.min("component").alias("lower"))
        )
        stepped = labels.join(around, "doc_id").select(
            "doc_id", "component", F.least("component", "lower").alias("next")
        )
        jump = labels.select(F.col("doc_id").alias("next"), F.col("component").alias("far"))
        moved = written(
            stepped.join(jump, "next", "left").select(
                "doc_id",
                F.least("next", F.coalesce("far", "next")).alias("component"),
                (F.least("next", F.coalesce("far", "next")) < F.col("component")).alias("changed"),
            ),
            f"{label}-labels",
        )
        labels = moved.select("doc_id", "component")
        if moved.where("changed").isEmpty():
            return labels


def _perhaps_in(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """``texts`` without most rows whose doc_id is not in ``needed``, before any shuffle.

    A bitmap of ``_FILTER`` hashed places, so of bounded size, is joined as a table of
    64-bit words. It lets every needed row through, and others only by chance; the
    more ids there are, the more others, up to all.
    """
    def word(place):
        return F.shiftright(place, 6)

    def bit(place):
        return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))

    place = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER))
    bitmap = needed.groupBy(word(place).alias("word")).agg(F.bit_or(bit(place)).alias("mask"))
    return (
        texts.where("doc_id IS NOT NULL")
        .withColumn("place", place)
        .withColumn("word", word(F.col("place")))
        .join(F.broadcast(bitmap), "word")
        .where(F.col("mask").bitwiseAND(bit(F.col("place"))) != 0)
        .select("doc_id", "text")
    )


def _comparisons(member: DataFrame, block: int) -> DataFrame:
    """Which members of a bucket (``key, n, doc_id, component``) meet in which block ``key, x, y``.

    Only buckets with several components are left to compare, and in them only pairs
    of different components: members of the most frequent component meet the others,
    not each other. A bucket of up to ``block`` members is one block. In a larger one,
    the others are dealt to blocks, which meet each other and the blocks of the
    most frequent component; a member goes to as many blocks as it has partners for.
    """
    per = member.groupBy("key", "component").agg(F.count("*").alias("m"))
    mixed = (
        per.groupBy("key")
        .agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("key", F.col("top.component").alias("most"), F.col("top.m").alias("n_most"))
    )
    zero = F.lit(0).cast("long")
    parts = lambda n: F.ceil(n / block).cast("long")
    placed = (
        member.join(mixed, "key")
        .withColumn("others", F.when(F.col("n") > block, parts(F.col("n") - F.col("n_most"))))
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(
            F.col("component") == F.col("most"), parts(F.col("n_most"))).otherwise(F.col("others"))))
    )
    one = F.struct(zero.alias("x"), zero.alias("y"), F.lit(0).alias("side"))
    own, others = F.col("own"), F.col("others")
    of_most = F.transform(
        F.sequence(zero, others - 1),
        lambda i: F.struct(i.alias("x"), (others + own).alias("y"), F.lit(1).alias("side")),
    )
    of_other = F.concat(
        F.transform(
            F.sequence(zero, others - 1),
            lambda i: F.struct(
                F.least(own, i).alias("x"), F.greatest(own, i).alias("y"),
                F.when(own <= i, 0).otherwise(1).alias("side"),
            ),
        ),
        F.transform(
            F.sequence(zero, parts(F.col("n_most")) - 1),
            lambda j: F.struct(own.alias("x"), (others + j).alias("y"), F.lit(0).alias("side")),
        ),
    )
    places = (
        F.when(F.col("n") <= block, F.array(one))
        .when(F.col("component") == F.col("most"), of_most)
        .otherwise(of_other)
    )
    return placed.select("key", "doc_id", "component", F.inline(places))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
    percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row.

    Two documents are linked if ``100 * intersection >= percent * union`` of their shingle
    sets (``size`` words). ``component_id`` is the smallest doc_id that links reach. With 32
    bands of 4, a pair at 0.8 shares no band, and is missed, once in 20 million.
    Documents without words are linked with nothing. Rows that repeat a doc_id are one document,
    linked to whatever one of its texts is linked to. A NULL doc_id has no component and
    its row is not kept. An empty table gives no rows.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    signed = written(signatures(texts, size, bands, rows), "signatures")
    live = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one document for each distinct set
    classes = written(
        live.groupBy("same").agg(
            F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    copies = live.select("doc_id", "same").join(
        classes.select("same", F.col("doc_id").alias("first")), "same"
    )
    copies = copies.where("doc_id <> first").select(
        F.col("first").alias("a"), F.col("doc_id").alias("b")
    )
    copies = written(copies.distinct(), "copies")

    keyed = classes.select("doc_id", F.explode("bands").alias("key"))
    buckets = _buckets(keyed)
    members = written(
        keyed.join(buckets.select("key", "n", "leader"), "key"), "bucket-members"
    )
    # an inner join stays above the filter, where a semi join would be moved below it; a
    # merge join because the ids grow with the documents
    needed = members.select("doc_id").distinct()
    at_hand = written(
        _perhaps_in(texts, needed).join(needed.hint("merge"), "doc_id"), "bucket-texts"
    )

    # every member with its leaders; large groups in parts, each with the leader
    pairs = members.where("doc_id <> leader").select("leader", "doc_id").distinct()
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / block).alias("parts"))
    roles = (
        pairs.join(parts, "leader")
        .select("leader", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), "doc_id",
                F.lit(False).alias("leads"))
        .unionAll(parts.select(
            "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            F.col("leader").alias("doc_id"), F.lit(True).alias("leads"),
        ))
    )
    links = written(
        roles.join(at_hand, "doc_id")
        .groupBy("leader", "part")
        .applyInPandas(_with_leader(size, percent), "a long, b long"),
        "leader-links",
    )
    first = components(links, "leaders")

    # buckets that still have members of different components, beyond leader and member
    member = (
        members.where("n > 2")
        .join(first, "doc_id", "left")
        .select("key", "n", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    )
    spread = _comparisons(member, block)
    more = written(
        spread.join(at_hand, "doc_id")
        .groupBy("key", "x", "y")
        .applyInPandas(_in_block(size, percent), "a long, b long"),
        "block-links",
    )
    labels = components(links.unionAll(more).unionAll(copies), "all")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return signed.join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def _buckets(keyed: DataFrame) -> DataFrame:
    """``key, n, leader`` of one bucket of each set of members, of those with more than one.

    Bands whose buckets have the same members say the same. The halves of the members' hashes
    are added up, as a doc_id that stands twice in a bucket would cancel in an exclusive or.
    """
    who = F.xxhash64("doc_id")
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("leader"),
        F.sum(F.shiftrightunsigned(who, 32)).alias("upper"),
        F.sum(who.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("lower"),
    ).where("n > 1")
    return buckets.groupBy("n", "leader", "upper", "lower").agg(F.min("key").alias("key"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, **options
) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id; the columns stay.

    Rows are told apart by a number of their own: unrelated texts under one id all stay, and of
    equal texts without an id one does. Rows without an id come after all others of
    their group, ties go to the row read first. Rows without words or text (NULL) have no
    duplicates and stay; an empty table stays empty.
    """
    number, own_id = unused(docs, "row_number"), unused(docs, "row_id")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, number, text_col, size=size, **options)
    ids = rows.select(number, F.col(id_col).cast("long").alias(own_id))
    best = F.min(F.struct(F.col(own_id).isNull().alias("last"), F.col(own_id), F.col(number)))
    kept = (
        found.select(F.col("doc_id").alias(number), "component_id").join(ids, number)
        .groupBy("component_id").agg(best.alias("best")).select(f"best.{number}")
    )
    return rows.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
