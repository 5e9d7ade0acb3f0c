"""What the operators share: tables written between steps, and ids of rows."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quernstone.session import scratch


def written(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: read back, it has no lineage to recompute.

    Lost executors cost only the running step, and a step that reads the table
    twice sees the same rows both times. ``options`` are the writer's.
    """
    path = scratch(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_ids():
    """Numbers that no other task of the stage gives out: partition, then a counter."""
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 40
    return itertools.count(first)


#: Columns of parameters that a task hands over, cut into parts that are added up apart;
#: the tokens (or texts) that it learned from are its weight.
PARTS = "start long, tokens long, part binary"
_PART = 4_096


def in_parts(flat: np.ndarray, tokens: int) -> pd.DataFrame:
    """One task's parameters as rows of ``PARTS``; none without tokens."""
    flat = flat.astype("f4")
    starts = list(range(0, len(flat), _PART)) if tokens else []
    return pd.DataFrame({"start": starts, "tokens": [tokens] * len(starts),
                         "part": [flat[s : s + _PART].tobytes() for s in starts]})


def averaged(parts: DataFrame) -> np.ndarray | None:
    """The weighted mean of all tasks' parameters: the driver receives one set, however many tasks there are."""

    def added(key, pdf):
        pdf = pdf.sort_values(["tokens", "part"], kind="stable")
        total = sum(
            np.frombuffer(part, "f4").astype("f8") * tokens
            for part, tokens in zip(pdf["part"], pdf["tokens"], strict=True)
        )
        mean = (total / pdf["tokens"].sum()).astype("f4")
        return pdf.iloc[:1].assign(part=[mean.tobytes()])

    rows = parts.groupBy("start").applyInPandas(added, PARTS).collect()
    rows.sort(key=lambda r: r["start"])
    return np.concatenate([np.frombuffer(r["part"], "f4") for r in rows]) if rows else None


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
