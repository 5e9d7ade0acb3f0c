"""Weighted samples of fixed size per stratum, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.windows import top_k_per_key

_BITS = 52  # of the hash; every such number, and half of one more, is a double


def weighted_sample(
    df: DataFrame, strata: list[str], row_id: str, weight: str, k: int, seed: int = 1
) -> DataFrame:
    """Up to ``k`` rows per stratum, drawn one after the other in proportion to ``weight``.

    A row's key is an exponential time with its weight as rate; the ``k`` earliest are drawn, and ``rank``
    tells their order. The time comes from a hash of ``seed`` and ``row_id``, so it depends on neither
    partitions nor runs; rows with one id share the hash and are told apart by weight only. Rows
    whose weight is NULL, NaN, infinite, 0 or less, or whose id is NULL, are never drawn. NULL strata are
    a stratum. Each input split keeps ``k`` rows of a stratum before the shuffle.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), 1, _BITS // 4)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**_BITS)
    rate = F.col(weight).cast("double")
    possible = df.where((rate > 0) & (rate < float("inf")) & F.col(row_id).isNotNull())
    timed = possible.withColumn("_time", -F.ln(share) / rate)
    return top_k_per_key(timed, strata, [F.col("_time"), F.col(row_id)], k).drop("_time")
