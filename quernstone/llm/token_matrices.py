"""Operator 2: token ids packed into binary matrices, best fit decreasing.

A task gathers pieces up to a fixed number of tokens, sorts them by length and puts
each into the open row with the least room that still holds it. The rows' rooms are
the leaves of a segment tree over room sizes: one descent finds the smallest room
that is large enough. No row of the input is shuffled; the rows leave as matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.tokens import WORD_BPE, words_of

#: Tokens that a task holds at once (4 bytes each), and rows of one written matrix.
GATHERED = 1_000_000
MATRIX_ROWS = 32


class RoomTree:
    """Which rooms (0 to ``capacity``) have open rows: a segment tree of counts over room sizes."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def pop(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, taken out; None if there is none."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            # up to the first ancestor whose right part has rows, then down its left edge
            while True:
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each 1 to ``capacity``); equal lengths keep their order."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.pop(lengths[i])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            tree.push(room - lengths[i], row)
    return rows


def token_matrices(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    tokenizer: str = WORD_BPE, end_id: int = 0, pad_id: int = 0,
    gathered: int = GATHERED, matrix_rows: int = MATRIX_ROWS,
) -> DataFrame:
    """One row per matrix of at most ``matrix_rows`` sequences of ``capacity`` ids.

    ``matrix_id``; ``n_rows``; ``ids``: row-major little-endian unsigned 32-bit, padded
    at the end of each sequence; ``cu_seqlens``: cumulative lengths of the segments in
    order, from 0; ``resets``: the places in the flat matrix where positions start again
    at 0 (each segment, and the padding of a sequence); ``doc_ids`` and ``starts``: of each
    segment, its document and the number of that document's ids before it, so that
    documents cut into segments go together again. Every text is encoded whole,
    followed by ``end_id``; NULL text is the end id alone, NULL ids are kept, repeated rows are
    packed as often as they occur, an empty table gives no rows.
    """
    schema = (
        "matrix_id long, n_rows int, ids binary, cu_seqlens array<long>, resets array<long>, "
        "doc_ids array<long>, starts array<long>"
    )
    longs = pa.list_(pa.int64())
    arrow = pa.schema([("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("ids", pa.binary()),
                       ("cu_seqlens", longs), ("resets", longs), ("doc_ids", longs),
                       ("starts", longs)])

    def matrices(pieces, ids, matrix_id):
        """``pieces``: (doc_id, start in document, place in ``ids``, length)."""
        rows = best_fit_decreasing([p[3] for p in pieces], capacity)
        for at in range(0, len(rows), matrix_rows):
            part = rows[at : at + matrix_rows]
            flat = np.full(len(part) * capacity, pad_id, "<u4")
            lengths, resets, doc_ids, starts = [0], [], [], []
            for r, row in enumerate(part):
                place = r * capacity
                for i in row:
                    doc_id, start, begin, length = pieces[i]
                    flat[place : place + length] = ids[begin : begin + length]
                    resets.append(place)
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lengths.append(length)
                    place += length
                if place < (r + 1) * capacity:
                    resets.append(place)
            values = (next(matrix_id), len(part), flat.tobytes(), np.cumsum(lengths).tolist(),
                      resets, doc_ids, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow
            )

    def run(batches):
        encode, end = words_of(tokenizer).ids, np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        matrix_id = iter(range((context.partitionId() if context else 0) << 32, 1 << 62))
        pieces, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                # a text longer than what is gathered leaves in parts
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    pieces.append((doc_id, start, size, len(part)))
                    held.append(part)
                    size += len(part)
                    if size >= gathered:
                        yield from matrices(pieces, np.concatenate(held), matrix_id)
                        pieces, held, size = [], [], 0
        if pieces:
            yield from matrices(pieces, np.concatenate(held), matrix_id)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, schema
    )


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Write to ``path`` as Parquet: ``ids`` uncompressed bytes, ready for ``numpy.frombuffer``."""
    matrices.write.option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The way back: ``doc_id, start, ids`` of every written segment, ids as in the matrix."""
    schema = "doc_id long, start long, ids binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                width = len(m["ids"]) // 4 // max(1, m["n_rows"])
                flat, out, place = np.frombuffer(m["ids"], "<u4"), [], 0
                lengths = np.diff(m["cu_seqlens"]).tolist()
                for doc_id, start, n in zip(m["doc_ids"], m["starts"], lengths, strict=True):
                    if place % width + n > width:  # the rest of the sequence is padding
                        place += width - place % width
                    out.append((doc_id, start, flat[place : place + n].tobytes()))
                    place += n
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    return spark.read.parquet(path).mapInArrow(run, schema)
