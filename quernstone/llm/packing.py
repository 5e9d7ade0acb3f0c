"""Operator 4: pack token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to islands
of bounded size. On an island, a solution is a list of bins; crossover takes whole
well-filled bins of one parent into the other, removes the bins that hold the same
pieces twice, and best-fits the pieces that lost their place. After the first epoch
each island sends the contents (lengths) of its best bins to the next one, which
rebuilds as many as its own pieces allow. The emptiest bin of each island is then
opened again, and these pieces meet on fewer islands, until one is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import row_ids, written
from quernstone.llm.tokens import WORD_BPE, words_of

#: Pieces that one island packs.
ISLAND = 4_096
#: Bins that an island sends on.
ELITE = 64

PIECE_FIELDS = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
    ("length", pa.int64()), ("ids_crc32", pa.int64()),
]
PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    tokenizer: str = WORD_BPE, end_id: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of each text's ids plus ``end_id``; ``ids`` (little-endian 32 bit) if asked for.

    Every document has a piece: a NULL or empty text is the end id alone. Only
    documents longer than ``capacity`` are cut. ``row`` numbers the pieces.
    """
    fields = PIECE_FIELDS + [("ids", pa.binary())] * keep_ids
    schema = PIECE_SCHEMA + ", ids binary" * keep_ids
    arrow = pa.schema(fields)

    def run(batches):
        encode, rows, step = words_of(tokenizer).ids, row_ids(), 4 * capacity
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (next(rows), doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, part) if keep_ids else row)
                    if keep_ids and len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays(_columns(out, arrow), schema=arrow)
                        out = []
            yield pa.RecordBatch.from_arrays(_columns(out, arrow), schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, schema
    )


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]


class Bins:
    """Bins of one solution under construction; the fullest that still fits comes first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if some bin has room r

    def add(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.room.append(room)
        self._open(len(self.bins) - 1, room)

    def _open(self, at: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(at)
            self.rooms |= 1 << room

    def best_fit(self, items, size) -> None:
        for item in items:
            need = size[item]
            fits = self.rooms >> need
            if not fits:
                self.add([item], self.capacity - need)
                continue
            room = need + (fits & -fits).bit_length() - 1
            held = self.by_room[room]
            at = held.pop()
            if not held:
                self.rooms ^= 1 << room
            self.bins[at].append(item)
            self.room[at] = room - need
            self._open(at, room - need)


def _fitness(solution: Bins) -> tuple[int, float]:
    """Fewer bins, then more unequal filling: an empty bin next to a full one can still vanish."""
    fill = 1.0 - np.array(solution.room) / solution.capacity
    return -len(solution.bins), float((fill * fill).sum())


def _crossed(a: Bins, b: Bins, size, rng) -> Bins:
    """``a`` with a share of ``b``'s well-filled bins injected whole."""
    order = np.argsort(b.room, kind="stable")
    good = order[: max(1, len(order) // 2)]
    chosen = good[rng.random(len(good)) < rng.uniform(0.2, 0.8)]
    if not len(chosen):
        chosen = good[:1]
    child, taken = Bins(a.capacity), set()
    for at in chosen:
        child.add(list(b.bins[at]), b.room[at])
        taken.update(b.bins[at])
    displaced = []
    for items, room in zip(a.bins, a.room, strict=True):
        if taken.isdisjoint(items):
            child.add(list(items), room)
        else:
            displaced += [i for i in items if i not in taken]
    child.best_fit(sorted(displaced, key=lambda i: -size[i]), size)
    return child


def _shaken(a: Bins, size, rng) -> Bins:
    """``a`` with its emptiest bins and a few others opened and best-fitted again."""
    n = len(a.bins)
    order = np.argsort(a.room, kind="stable")
    opened = {*order[-max(1, n // 20) :].tolist(), *rng.integers(0, n, max(1, n // 20)).tolist()}
    child, displaced = Bins(a.capacity), []
    for at in range(n):
        if at in opened:
            displaced += a.bins[at]
        else:
            child.add(list(a.bins[at]), a.room[at])
    child.best_fit(sorted(displaced, key=lambda i: -size[i] * rng.uniform(0.8, 1.2)), size)
    return child


def _rebuilt(patterns, size, capacity: int) -> Bins:
    """Immigrant bins, as far as this island has pieces of their lengths; the rest best-fit."""
    at_hand: dict[int, list[int]] = {}
    for item, length in enumerate(size):
        at_hand.setdefault(length, []).append(item)
    out, used = Bins(capacity), set()
    for pattern in patterns:
        picked = []
        for length in pattern:
            if not at_hand.get(length):
                break
            picked.append(at_hand[length].pop())
        if len(picked) == len(pattern):
            out.add(picked, capacity - sum(pattern))
            used.update(picked)
        else:
            for item in picked:
                at_hand[size[item]].append(item)
    out.best_fit([i for i in range(len(size)) if i not in used], size)
    return out


def evolve(
    size: list[int], capacity: int, seed: int, starts=(), population: int = 6, generations: int = 12
) -> Bins:
    """Pack pieces of descending ``size``; stops at the bound that no packing beats."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(size) // capacity)
    first = Bins(capacity)
    first.best_fit(range(len(size)), size)
    pool = [first, *starts]
    best = max(pool, key=_fitness)
    if len(best.bins) <= bound:
        return best
    while len(pool) < population:
        noise = np.array(size) * rng.uniform(0.85, 1.15, len(size))
        one = Bins(capacity)
        one.best_fit(np.argsort(-noise, kind="stable").tolist(), size)
        pool.append(one)
    for _ in range(generations):
        a, b = (max(rng.choice(len(pool), 2, replace=False), key=lambda i: _fitness(pool[i]))
                for _ in range(2))
        child = _crossed(pool[a], pool[b], size, rng)
        if rng.random() < 0.5:
            child = _shaken(child, size, rng)
        worst = min(range(len(pool)), key=lambda i: _fitness(pool[i]))
        if _fitness(child) > _fitness(pool[worst]):
            pool[worst] = child
        best = max(pool, key=_fitness)
        if len(best.bins) <= bound:
            break
    return best


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)


def _first_epoch(capacity: int, islands: int, seed: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size = _ordered(pdf)["length"].tolist()
        found = evolve(size, capacity, seed + key[0])
        placed = np.empty(len(size), "<i4")
        for at, items in enumerate(found.bins):
            placed[items] = at
        order = [b for b in np.argsort(found.room, kind="stable") if len(found.bins[b]) > 1]
        elite = [[size[i] for i in found.bins[b]] for b in order[:ELITE]]
        return pd.DataFrame(
            {"island": [key[0]], "next": [(key[0] + 1) % islands], "bins": [len(found.bins)],
             "placed": [placed.tobytes()], "elite": [elite]}
        )

    return run


def _second_epoch(capacity: int, seed: int):
    def run(key, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        size = pdf["length"].tolist()
        own = Bins(capacity)
        placed = np.frombuffer(state["placed"].iloc[0], "<i4")
        order = np.argsort(placed, kind="stable")
        for items in np.split(order, np.flatnonzero(np.diff(placed[order])) + 1):
            items = items.tolist()
            own.add(items, capacity - sum(size[i] for i in items))
        best = own
        if len(own.bins) > -(-sum(size) // capacity):
            guests = _rebuilt([list(map(int, p)) for p in state["elite"].iloc[0]], size, capacity)
            best = evolve(size, capacity, seed + 7919 * (key[0] + 1), (own, guests))
        sequence, offset = np.empty(len(size), "i8"), np.empty(len(size), "i8")
        loose = np.zeros(len(size), bool)
        emptiest = int(np.argmax(best.room))
        for at, items in enumerate(best.bins):
            full = 0
            for i in items:
                sequence[i], offset[i] = at, full
                full += size[i]
            if at == emptiest and best.room[at]:
                loose[items] = True
        pdf["sequence_id"] = (key[0] << 24) + sequence
        pdf["offset"] = offset
        pdf["loose"] = loose
        return pdf

    return run


def pack_pieces(
    pieces: DataFrame, capacity: int = 2048, island: int = ISLAND, seed: int = 4
) -> DataFrame:
    """``pieces`` (a written table with ``row`` and ``length``) plus ``sequence_id, offset``.

    Lengths are 1 to ``capacity``. Pieces of a sequence follow each other without gaps
    from offset 0. Other columns stay; none may be named like the added ones. Columns
    with NULLs are safe if pandas keeps their type, so ids should go as text or non-null.
    """
    columns, out, level = pieces.columns, [], 0
    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    left = pieces
    while True:
        islands = max(1, -(-left.count() // island))
        dealt = left.withColumn(
            "island", F.pmod(F.xxhash64("row", F.lit(seed + level)), F.lit(islands))
        )
        first = written(
            dealt.select("island", "row", "length")
            .groupBy("island")
            .applyInPandas(
                _first_epoch(capacity, islands, seed + level),
                "island long, next long, bins long, placed binary, elite array<array<long>>",
            ),
            f"pack-epoch1-{level}",
        )
        state = first.select("island", "placed").join(
            first.select(F.col("next").alias("island"), "elite"), "island"
        )
        packed = dealt.groupBy("island").cogroup(state.groupBy("island")).applyInPandas(
            _second_epoch(capacity, seed + level),
            f"{kinds}, island long, sequence_id long, offset long, loose boolean",
        )
        packed = written(
            packed.withColumn("sequence_id", F.col("sequence_id") + F.lit(level << 56)),
            f"pack-epoch2-{level}",
        )
        if islands == 1:
            out.append(packed)
            break
        out.append(packed.where("NOT loose"))
        left, level = packed.where("loose").select(*columns), level + 1
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result.select(*columns, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    tokenizer: str = WORD_BPE, end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    NULL ids are kept, repeated rows are packed as often as they occur, an empty
    table gives no rows.
    """
    pieces = token_pieces(docs, id_col, text_col, capacity, tokenizer, end_id)
    pieces = written(
        pieces.withColumn("no_id", F.col("doc_id").isNull()).withColumn(
            "doc_id", F.coalesce("doc_id", F.lit(0))
        ),
        "pieces",
    )
    packed = pack_pieces(pieces, capacity)
    return packed.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    )
