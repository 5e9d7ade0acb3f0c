"""User-defined functions for what no built-in function does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two words from 0 to 1: common letters near each other, common beginnings weigh more."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, of_a = [False] * len(b), []
    for i, letter in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == letter:
                taken[j] = True
                of_a.append(letter)
                break
    if not of_a:
        return 0.0
    of_b = [letter for letter, used in zip(b, taken, strict=True) if used]
    common = len(of_a)
    swapped = sum(x != y for x, y in zip(of_a, of_b, strict=True)) // 2
    jaro = (common / len(a) + common / len(b) + (common - swapped) / common) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler; each distinct pair of a batch is compared once. NULL with NULL on a side."""
    known: dict[tuple, float | None] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = None if None in pair else jaro_winkler(*pair)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="Float64")


@F.pandas_udf(T.DoubleType())
def smoothed(at: pd.Series, value: pd.Series, weight: pd.Series) -> float:
    """Exponential smoothing in the order of ``at``: each value counts ``weight``, all before it the rest."""
    out = None
    share = float(weight.iloc[0])
    for v in value.iloc[at.argsort()]:
        out = v if out is None else share * v + (1 - share) * out
    return float("nan") if out is None else float(out)


@F.arrow_udtf(
    returnType=T.StructType()
    .add("key", T.LongType())
    .add("position", T.IntegerType())
    .add("n_words", T.IntegerType())
    .add("phrase", T.StringType())
)
class Phrases:
    """Table argument (key, text) -> every run of consecutive words, whole Arrow batches at a time."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = [] if text is None else text.split(" ")
            for start in range(len(words)):
                for stop in range(start + 1, len(words) + 1):
                    rows.append((key, start, stop - start, " ".join(words[start:stop])))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.Table.from_arrays(arrays, names=["key", "position", "n_words", "phrase"])
