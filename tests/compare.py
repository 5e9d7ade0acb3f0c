"""Compare a Spark result with a DuckDB result: names, kinds of type, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from quernstone.sources import SCHEMAS

_KINDS = {
    "tinyint": "int", "smallint": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "int": "int", "long": "int", "string": "text", "varchar": "text", "double": "float",
    "float": "float", "timestamp": "time", "timestamp_ntz": "time", "boolean": "bool",
    "date": "date",
}


def duck(sf_dir: str | Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return ("NaN",)  # equal to itself, not to NULL
    if isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, Decimal):
        return v.normalize()
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return v
    return repr(v)


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def kinds_of(pairs) -> dict[str, str]:
    return {name: _KINDS.get(str(kind).lower(), str(kind).lower()) for name, kind in pairs}


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty string if equal, else what differs."""
    expected = con.sql(sql)
    ours, theirs = kinds_of(df.dtypes), kinds_of(zip(expected.columns, expected.types))
    if ours != theirs:
        return f"columns differ: {ours} / {theirs}"
    a = rows_of(df.columns, df.collect())
    b = rows_of(expected.columns, expected.fetchall())
    if a == b:
        return ""
    return (
        f"{sum(a.values())} / {sum(b.values())} rows; only here: {list((a - b).items())[:3]}; "
        f"only there: {list((b - a).items())[:3]}"
    )
