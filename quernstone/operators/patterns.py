"""Row patterns: matches of a small automaton over each key's rows in time order.

A slice of rows is a function: whatever state the automaton enters it with, it leaves with
a state, and either the attempt it brought along or one begun inside. Such functions
compose, so a key that runs through many slices is scanned in all of them at once: first every
cut piece is summed up for every state it may be entered with, then the few summaries of a key
are folded, and last every slice is scanned from the state it really starts in.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import micros
from quernstone.operators.hot_keys import ROWS_PER_SLICE, cut_keys, in_slices

_NONE = -1
#: Stands for the row at which the attempt began that the entry state brought along.
_BROUGHT = -2
_NO_TIME = -(2**62)


class Automaton(NamedTuple):
    """``moves[state][symbol]`` is the next state; 0 is idle, a symbol without a move leads there.

    A row that leads out of 0 begins an attempt; so does one whose (state, symbol) is among
    ``begins``, which ends the attempt before it. An attempt that reaches a state of
    ``accepts`` is a match up to the last row that left it in such a state.
    """

    moves: tuple[dict[str, int], ...]
    accepts: frozenset[int]
    begins: frozenset[tuple[int, str]] = frozenset()

    def table(self, symbols: list[str]) -> list[list[tuple[int, bool]]]:
        """``[state][symbol number] -> (next state, whether an attempt begins)``."""
        return [
            [
                (to := moves.get(s, 0), bool(to) and (state == 0 or (state, s) in self.begins))
                for s in symbols
            ]
            for state, moves in enumerate(self.moves)
        ]


def _scan(table, symbols, nth, at, entry, accepts=frozenset(), found=None):
    """Run over one key's rows from ``entry``: (state, begun at row, at time, rows so far)."""
    state, row, time, length = entry
    for symbol, n, t in zip(symbols, nth, at, strict=True):
        state, begins = table[state][symbol]
        if begins:
            row, time, length = n, t, 0
        if not state:
            row, time, length = _NONE, 0, 0
            continue
        length += 1
        if state in accepts:
            found[row] = (time, t, length)
    return state, row, time, length


def matches(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie_break: list[str],
    symbol: Column,
    automaton: Automaton,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``keys, start_ts, end_ts, n_rows`` of every match, by the order of ``ts`` and ``tie_break``.

    ``symbol`` is a string column. Attempts do not overlap. Rows without a time come first, as
    NULLs do in Spark's order; a match that starts there has a NULL time. A NULL key is a key.
    Every slice holds a bounded number of narrow rows; only keys that lie in several
    slices are scanned twice.
    """
    kind = df.schema[ts].dataType
    known = sorted({s for moves in automaton.moves for s in moves})
    number = F.coalesce(
        F.array_position(F.array(*map(F.lit, known)), symbol), F.lit(0).cast("long")
    )
    order = [ts, *tie_break]
    narrow = df.select(
        *keys, *[c for c in order if c not in keys],
        F.coalesce(micros(ts), F.lit(_NO_TIME)).alias("_at"), number.cast("int").alias("_symbol"),
        F.monotonically_increasing_id().alias("_nth"),
    )
    rows = in_slices(narrow, keys, [F.col(c) for c in [*order, "_nth"]], rows_per_slice)
    in_order = Window.partitionBy("_slice").orderBy(*order, "_nth")
    rows = rows.withColumn("_order", F.row_number().over(in_order)).select(
        *keys, "_slice", "_order", "_symbol", "_nth", "_at"
    )
    table = automaton.table(["", *known])
    states = range(len(automaton.moves))
    key_schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def by_key(part: pa.Table, columns: list[str]) -> dict[tuple, list[list]]:
        """Key -> the key's values of each column, in order."""
        out: dict[tuple, list[list]] = {}
        part = part.sort_by("_order")
        whose = zip(*(part[c].to_pylist() for c in keys), strict=True)
        values = zip(*(part[c].to_pylist() for c in columns), strict=True)
        for key, row in zip(whose, values, strict=True):
            out.setdefault(key, []).append(row)
        return {key: list(zip(*rows, strict=True)) for key, rows in out.items()}

    def as_table(part: pa.Table, found: list[tuple], **kinds) -> pa.Table:
        schema = pa.schema([*(part.schema.field(c) for c in keys), *kinds.items()])
        columns = zip(*found, strict=True) if found else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

    def summed_up(part: pa.Table) -> pa.Table:
        out, number = [], part["_slice"][0].as_py()
        for key, columns in by_key(part, ["_symbol", "_nth", "_at"]).items():
            ends = [_scan(table, *columns, (s, _BROUGHT if s else _NONE, 0, 0)) for s in states]
            out.append((*key, number, *map(list, zip(*ends, strict=True))))
        longs = pa.list_(pa.int64())
        return as_table(part, out, _slice=pa.int32(), _states=pa.list_(pa.int32()), _rows=longs,
                        _times=longs, _lengths=longs)

    def folded(part: pa.Table) -> pa.Table:
        """The state in which a key enters each of its slices."""
        part = part.sort_by("_slice")
        key = tuple(part[c][0].as_py() for c in keys)
        entry, out = (0, _NONE, 0, 0), []
        columns = ["_slice", "_states", "_rows", "_times", "_lengths"]
        for i, *ends in zip(*(part[c].to_pylist() for c in columns), strict=True):
            out.append((*key, i, *entry))
            to, row, time, length = (end[entry[0]] for end in ends)
            if row == _BROUGHT:  # still the attempt that came in
                row, time, length = entry[1], entry[2], entry[3] + length
            entry = (to, row, time, length)
        long = pa.int64()
        return as_table(part, out, _slice=pa.int32(), _state=pa.int32(), _row=long, _time=long,
                        _length=long)

    lists = "_states array<int>, _rows array<long>, _times array<long>, _lengths array<long>"
    registers = {"_state": "int", "_row": "long", "_time": "long", "_length": "long"}
    entries = (
        cut_keys(rows, keys).groupBy("_slice")
        .applyInArrow(summed_up, f"{key_schema}, _slice int, {lists}")
        .groupBy(*keys).applyInArrow(
            folded, f"{key_schema}, _slice int, " + ", ".join(f"{c} {t}" for c, t in registers.items())
        )
    )
    both = rows.withColumns({c: F.lit(_NONE).cast(t) for c, t in registers.items()}).unionByName(
        entries.withColumns({c: F.lit(0).cast(t) for c, t in rows.dtypes if c[0] == "_" and c != "_slice"})
    )

    def scanned(part: pa.Table) -> pa.Table:
        out = []
        for key, columns in by_key(part, ["_symbol", "_nth", "_at", *registers]).items():
            entry, first = (0, _NONE, 0, 0), 0
            if columns[3][0] != _NONE:  # a row of its own, before all others
                entry, first = tuple(c[0] for c in columns[3:]), 1
            found: dict[int, tuple] = {}
            _scan(table, *(c[first:] for c in columns[:3]), entry, automaton.accepts, found)
            out += [(*key, row, *match) for row, match in found.items()]
        long = pa.int64()
        return as_table(part, out, _row=long, _start=long, _end=long, _length=long)

    # a match that runs on into other slices is found again there, longer
    spans = both.groupBy("_slice").applyInArrow(
        scanned, f"{key_schema}, _row long, _start long, _end long, _length long"
    )
    whole = spans.groupBy(*keys, "_row").agg(F.max(F.struct("_length", "_end", "_start")).alias("_m"))

    def time(column: str) -> Column:
        value = F.col(column)
        return F.when(value > _NO_TIME, F.timestamp_micros(value)).cast(kind)

    return whole.select(
        *keys, time("_m._start").alias("start_ts"), time("_m._end").alias("end_ts"),
        F.col("_m._length").alias("n_rows"),
    )


#: Falls followed by rises: the last rise may be followed by anything but another rise.
VALLEYS = Automaton(
    moves=({"fall": 1}, {"fall": 1, "rise": 2}, {"fall": 1, "rise": 2}),
    accepts=frozenset({2}),
    begins=frozenset({(2, "fall")}),
)
