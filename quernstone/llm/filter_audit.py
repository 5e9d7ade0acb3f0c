"""Operator 11: how five filters of a corpus interact, kept by a stream that retracts.

The documents' files arrive as a bounded number of micro-batches. A document becomes a mask of the
filters it fails; whether it fails the last one (its text stands under a smaller id) may
change with every batch. Keyed state holds, for every text, the smallest id so far and
the masks counted for it. When a smaller id arrives, the state retracts what it had counted
and counts it again as a copy. The sum of all such changes per part is the counters that
a plain pass over the whole table would give, in whatever order the files come.

State is keyed by buckets of text hashes, so that one call handles thousands of texts. Rows of
one text are combined within a task before they are shuffled: a text with a third of all rows
reaches its bucket as a few.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quernstone.llm.common import written
from quernstone.session import scratch, settings

FILTERS = "ABCDE"
#: Bits of a mask: the filters in order, then whether a document is labelled good or toxic.
COPY, GOOD, TOXIC = 1 << 4, 1 << 5, 1 << 6
#: Texts of one state bucket, about, and micro-batches of a run.
PER_BUCKET = 20_000
BATCHES = 4

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = re.compile(rb"[#$%&*|]")
_ROWS = "who binary, id long, part string, bits int, n long"
_KEYS = ["who", "id", "part", "bits"]


def failed(text: bytes, code_points: int) -> int:
    """Which of the first four filters a text in UTF-8 fails, as bits."""
    words = text.split()  # bytes split at exactly the six ASCII white-space characters
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * upper > 5 * code_points) << 2
        | (_SIGNS.search(text) is not None) << 3
    )


def _masks(batches):
    """Texts -> ``who`` (hash of the text), id, part, bits, n; equal rows as one.

    Without an id, ``who`` is NULL and the id 0: it is never smaller than another, nor the other way round.
    """
    schema = pa.schema([("who", pa.binary()), ("id", pa.int64()), ("part", pa.string()),
                        ("bits", pa.int32()), ("n", pa.int64()), ("spread", pa.int64())])
    spread = itertools.count()
    for batch in batches:
        rows: dict[tuple, int] = {}
        ids, texts, points, parts = batch.columns
        for id_, text, n, part in zip(
            ids.to_pylist(), texts, points.to_pylist(), parts.to_pylist(), strict=True
        ):
            raw = text.as_py()
            who = None if id_ is None else hashlib.sha256(raw).digest()[:16]
            key = (who, id_ or 0, part, failed(raw, n))
            rows[key] = rows.get(key, 0) + 1
        if rows:
            columns = [*zip(*rows, strict=True), list(rows.values()), [next(spread) for _ in rows]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )


def _summed(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    return rows.groupby(keys, sort=False, as_index=False)["n"].sum()


def _combined(buckets: int):
    """Within a task: of every text only the rows of its smallest id stay apart.

    All others are copies whatever else arrives, and rows without id never are; both only add to
    the counters, so they travel as sums, spread over the buckets.
    """

    def run(batches):
        context = TaskContext.get()
        turn = itertools.count(context.partitionId() if context else 0)
        for rows in batches:
            known = rows["who"].notna()
            low = rows[known].groupby("who")["id"].transform("min")
            copies = pd.Series(False, index=rows.index)
            copies[low.index] = rows.loc[low.index, "id"] > low
            sums = rows[copies | ~known].copy()
            sums["bits"] |= np.where(copies[sums.index], COPY, 0)
            sums = _summed(sums, ["part", "bits"]).assign(who=None, id=0)
            sums["bucket"] = [next(turn) % buckets for _ in range(len(sums))]
            first = _summed(rows[known & ~copies], _KEYS)
            first["bucket"] = [int.from_bytes(w[:8], "big") % buckets for w in first["who"]]
            out = pd.concat([first, sums], ignore_index=True)
            yield out[["bucket", *_KEYS, "n"]].astype({"bits": "int32", "bucket": "int32", "id": "int64"})

    return run


#: 37 bytes a text: the parts' names stand once in a bucket.
_STATE = pa.schema([("who", pa.binary(16)), ("id", pa.int64()),
                    ("part", pa.dictionary(pa.int32(), pa.string())), ("bits", pa.int8()),
                    ("n", pa.int64())])


def _stored(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STATE) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema=_STATE, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _restored(entries: bytes | None) -> pd.DataFrame:
    table = pa.ipc.open_stream(entries).read_all() if entries else _STATE.empty_table()
    return table.to_pandas().astype({"part": "object", "bits": "int32"})


def merged_state(old: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``(state, changes)`` after ``new`` rows (``who, id, part, bits, n``) met the ``old`` state.

    ``changes`` (``part, bits, n``): what is new counts as original or as copy; where a smaller
    id arrived, what the state had counted is retracted and counted again as a copy.
    """
    rows = pd.concat([old.assign(counted=True), new.assign(counted=False)], ignore_index=True)
    loses = rows["id"] > rows.groupby("who")["id"].transform("min")
    back = rows[rows["counted"] & loses]
    fresh = rows[~rows["counted"] & ~loses]
    copies = rows[loses]
    changes = pd.concat([
        fresh[["part", "bits", "n"]],
        copies[["part", "n"]].assign(bits=copies["bits"] | COPY),
        back[["part", "bits"]].assign(n=-back["n"]),
    ])
    return _summed(rows[~loses], _KEYS), _summed(changes, ["part", "bits"])


def _retract(key, batches, state):
    rows = pd.concat(list(batches), ignore_index=True)
    old = _restored(state.get[0] if state.exists else None)
    plain = rows["who"].isna()
    new = rows.loc[~plain, [*_KEYS, "n"]]
    held, changes = merged_state(old, new)
    if len(new):
        state.update((_stored(held),))
    changes = _summed(pd.concat([changes, rows.loc[plain, ["part", "bits", "n"]]]), ["part", "bits"])
    changes = changes[changes["n"] != 0]
    yield changes[["part", "bits", "n"]].astype({"bits": "int32", "n": "int64"})


def retracted_counters(
    docs: DataFrame, labels: DataFrame, buckets: int, id_col: str = "doc_id",
    text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """``part, bits, n`` of all documents of the stream ``docs``, run over what is available.

    ``bits``: the failed filters (1, 2, 4, 8, 16 for A to E), 32 for a good and 64 for a toxic label;
    a document is good or toxic if any label row of its id says so. NULL text is empty, a NULL
    part the empty string. Rows that share the smallest id of a text are all originals; rows
    without id are never copies, nor do others become copies by them.
    """
    flags = written(
        labels.groupBy(F.col("doc_id").alias("labelled")).agg(
            (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0))
             + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("flags")
        ).where("labelled IS NOT NULL AND flags > 0"),
        "label-flags",
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    masks = docs.select(
        F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"),
        F.length(text).alias("points"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    ).mapInArrow(_masks, f"{_ROWS}, spread long")
    # rows without id find no label; their spread keeps them from meeting in one task
    labelled = masks.withColumns(
        {
            "labelled": F.when(F.col("who").isNull(), F.col("spread")).otherwise(F.col("id")),
            "has_id": F.col("who").isNotNull(),
        }
    ).join(flags.withColumn("has_id", F.lit(True)), ["labelled", "has_id"], "left")
    bits = F.col("bits").bitwiseOR(F.coalesce("flags", F.lit(0)))
    rows = labelled.select("who", "id", "part", bits.cast("int").alias("bits"), "n")
    changes = (
        rows.mapInPandas(_combined(buckets), f"bucket int, {_ROWS}")
        .groupBy("bucket")
        .applyInPandasWithState(
            _retract, "part string, bits int, n long", "entries binary", "append",
            GroupStateTimeout.NoTimeout,
        )
    )
    return (
        _all_changes(changes).groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0")
    )


def _all_changes(changes: DataFrame) -> DataFrame:
    """Run the stream over what is available; the file sink's log makes a retried batch harmless.

    The session's state store holds 37 bytes a text: in memory by default, one version of it.
    """
    spark = changes.sparkSession
    base = scratch(spark, "filter-changes")
    with settings(spark, spark__sql__streaming__maxBatchesToRetainInMemory="1"):
        query = (
            changes.writeStream.format("parquet").outputMode("append")
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{base}/out")


def _steps() -> list[tuple[str, int, int, int]]:
    """Order, step, the step's filter as a bit, and the bits of the filters before it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, 1 << f, before))
            before |= 1 << f
    return out


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _report(rows: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its at most 128 counters."""
    steps = _steps()
    bits, n = rows["bits"].to_numpy("i8"), rows["n"].to_numpy("i8")
    mask = bits & 31
    bit, before = (np.array([s[i] for s in steps])[:, None] for i in (2, 3))
    fails, earlier = (mask & bit) > 0, (mask & before) > 0
    removed = fails & ~earlier
    which = [
        (mask & (bit | before)) == 0, removed, fails & earlier, mask == bit,
        removed & ((bits & GOOD) > 0), removed & ((bits & TOXIC) > 0),
    ]
    out = pd.DataFrame({name: w @ n for name, w in zip(_COUNTS, which, strict=True)})
    out["filter_order"], out["step"] = [s[0] for s in steps], [s[1] for s in steps]
    out["shapley"] = out.groupby(bit[:, 0])["removed"].transform("sum")
    out["part"] = rows["part"].iloc[0]
    return out


def audit_filters(
    docs: DataFrame, labels: DataFrame, buckets: int, id_col: str = "doc_id",
    text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """Counts per part, order of the five filters, and step.

    ``docs`` is a stream of documents; see ``retracted_counters`` for NULLs and repeated rows. The filters:
    under 50 words; 100 distinct words < 65 words; 100 capital letters > 5 code points; one of
    ``#$%&*|``; the text of a smaller id. Parts without documents do not appear, so an
    empty table gives no rows.
    """
    counters = retracted_counters(docs, labels, buckets, id_col, text_col, part_col)
    longs = ", ".join(f"{c} long" for c in [*_COUNTS, "shapley"])
    return counters.groupBy("part").applyInPandas(
        _report, f"part string, filter_order string, step int, {longs}"
    )
