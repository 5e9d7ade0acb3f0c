"""Operator 9: mix sources to target weights by pivotal dependent rounding.

Every document should appear ``f = target / size of its source`` times; ``f`` is
rarely whole. Rounding each document alone would miss the target by chance.
Pivotal rounding pairs two fractional documents and moves words from one to the
other, at random and without changing the expectation of either, until one of them
is whole; the words of the pair stay the same. A chunk of a source so ends with at
most one fractional document. These residuals meet in chunks of residuals, level by
level, until a source has one left; only that one is decided by a coin.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import unused, written

#: Documents that one task rounds in one piece; more become more chunks, not larger ones.
CHUNK = 2_048
#: No document appears more often, and no source is stretched further.
MOST = 3


def word_count(text: str | Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed, return; NULL: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``source, source_size, n, target`` from ``source, size`` rows.

    ``n`` counts the rows with words.

    Sources in code point order (NULL last) weigh ``weights``, repeating. Their
    targets share all words by weight, stop at ``most`` times a source's size, and
    what is above is shared again by weight among the others. Only sums reach the
    driver; ranks come from a range-partitioned sort, not from one task.
    """
    totals = written(
        sizes.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")
        ),
        "source-sizes",
    )
    # equal partitions of a sort by range, each numbered on its own, then shifted
    spread = written(
        totals.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "source-ranks",
    )
    parts = spread.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")
    )
    rank = F.col("before") + F.col("at") - F.col("first")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")
    )
    weighed = written(
        spread.join(parts, "part").select("source", "source_size", "n", weight.alias("weight")),
        "source-weights",
    )
    everything = weighed.agg(F.sum("source_size")).first()[0] or 0
    full = F.lit(False)
    level = 0.0
    while True:
        row = weighed.agg(
            F.sum(F.when(full, F.col("source_size") * most)).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not row["weight"]:
            break
        level = (everything - (row["capped"] or 0)) / row["weight"]
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * most
        if weighed.where(full).count() == row["n"]:
            break
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(
        F.col("weight") * F.lit(level)
    )
    return weighed.select("source", "source_size", "n", target.alias("target"))


def _coin(seed: int, *what) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    digest = hashlib.blake2b(repr((seed, *what)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2**64


def pivot(size: np.ndarray, part: np.ndarray, coins: np.ndarray) -> int:
    """Round ``part`` (each in [0, 1]) in place, keeping the sum of ``size * part``.

    Returns the index left fractional, or -1. One pass: the fractional one so far
    meets the next; one of the two becomes 0 or 1.
    """
    held = -1
    for i in range(len(size)):
        if not 0.0 < part[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1.0 - part[held]) * a, part[i] * b)  # words from i to held
        down = min(part[held] * a, (1.0 - part[i]) * b)
        if coins[i] * (up + down) < down:  # probability down / (up + down) keeps expectations
            whole = (1.0 - part[held]) * a <= part[i] * b
            left = part[i] - up / b
            if whole:
                part[held] = 1.0
                part[i] = left
                held = i
            else:
                part[held] += up / a
                part[i] = 0.0
        else:
            whole = part[held] * a <= (1.0 - part[i]) * b
            left = part[i] + down / b
            if whole:
                part[held] = 0.0
                part[i] = left
                held = i
            else:
                part[held] -= down / a
                part[i] = 1.0
        if not 1e-12 < part[held] < 1.0 - 1e-12:
            part[held] = round(part[held])
            held = -1
    return held


def _round_chunk(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large ones first: what is left open at the end tends to be small
        pdf = pdf.sort_values(
            ["size", "key", "nth"], ascending=[False, True, True], kind="stable", ignore_index=True
        )
        size, part = pdf["size"].to_numpy(float), pdf["part"].to_numpy(float).copy()
        chunks, chunk = int(pdf["chunks"].iloc[0]), int(pdf["chunk"].iloc[0])
        name = (pdf["source"].iloc[0], chunk, level)
        coins = np.random.default_rng(int(_coin(seed, *name) * 2**63)).random(len(pdf))
        held = pivot(size, part, coins)
        if held >= 0 and chunks == 1:
            part[held] = float(_coin(seed, *name, "last") < part[held])
            held = -1
        pdf["part"] = part
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), seed: int = 9, most: int = MOST, chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: ``id, nth, source, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix takes the document, ``taken`` the words that makes.
    NULL text has size 0; NULL source is a source of its own, last in order; NULL ids
    are kept. Equal rows are numbered by ``nth`` and rounded separately. Rows without
    words, which no target moves, are rounded by a coin of their own key. Results
    depend on the rows alone, not on their order or partitions. Empty tables give no
    rows.
    """
    sizes = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
    )
    # equal rows are counted, not listed, before they are shuffled
    grouped = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("times"))
    sizes = written(
        grouped.select(
            F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"),
            "source", "size", F.xxhash64("id", "source", "size").alias("key"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("nth"),
        ),
        "mix-sizes",
    )
    goals = written(targets(sizes, weights, most), "mix-targets")
    columns = ["id", "no_id", "nth", "source", "size", "key", "whole", "part"]
    goal = ["source_size", "target", "chunks"]
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    often = F.coalesce(often, F.lit(1.0))
    parts = (
        sizes.join(goals.withColumnRenamed("source", "of"), F.expr("source <=> of"))
        .withColumn("whole", F.floor(often).cast("long"))
        .withColumn("part", often - F.floor(often))
        .withColumn("chunks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / chunk)))
        .select(*columns, *goal)
    )
    # 53 bits fit a double exactly
    coin = F.pmod(F.xxhash64(F.lit(seed), "key", "nth"), F.lit(2**53)) / F.lit(float(2**53))
    done = [
        parts.where("size = 0").withColumn("part", (coin < F.col("part")).cast("double"))
    ]
    live, level = parts.where("size > 0"), 0
    schema = (
        "id long, no_id boolean, nth long, source string, size long, key long, whole long, "
        "part double, source_size long, target double, chunks long, chunk long, open boolean"
    )
    while True:
        placed = live.withColumn(
            "chunk", F.pmod(F.xxhash64(F.lit(seed + level), "key", "nth"), F.col("chunks"))
        )
        rounded = written(
            placed.groupBy("source", "chunk").applyInPandas(_round_chunk(seed, level), schema),
            f"mix-level{level}",
        )
        done.append(rounded.where("NOT open").select(*columns, *goal))
        live, level = rounded.where("open"), level + 1
        if live.isEmpty():
            break
        # a chunk leaves one open row at most
        live = live.withColumn("chunks", F.ceil(F.col("chunks") / chunk)).select(*columns, *goal)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    copies = F.least(F.col("whole") + F.round("part").cast("long"), F.lit(most).cast("long"))
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("id"), "nth", "source", "size", "source_size",
        "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    **options,
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; the columns stay.

    Rows equal in id, source and size share their copies evenly: sizes are what counts.
    """
    who, row, of = (unused(docs, f"mix_{name}") for name in ("who", "row", "of"))
    copies, rows, times = (unused(docs, f"mix_{name}") for name in ("copies", "rows", "times"))

    def key(identity, source, size):
        return F.struct(
            F.coalesce(identity, F.lit(0).cast("long")).alias("id"),
            identity.isNull().alias("no_id"),
            F.coalesce(source, F.lit("")).alias("source"),
            source.isNull().alias("no_source"),
            size.alias("size"),
        )

    plan = (
        mix(docs, id_col, text_col, source_col, **options)
        .groupBy(key(F.col("id"), F.col("source"), F.col("size")).alias(of))
        .agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
        .where(F.col(copies) > 0)
    )
    own = key(F.col(id_col).cast("long"), F.col(source_col).cast("string"), word_count(text_col))
    joined = docs.withColumn(who, own).join(plan, F.col(who) == F.col(of))
    nth = F.row_number().over(Window.partitionBy(who).orderBy(F.col(text_col))) - 1
    share = F.floor(F.col(copies) / F.col(rows)) + (nth < F.col(copies) % F.col(rows)).cast("long")
    return (
        joined.withColumn(times, share)
        .where(F.col(times) > 0)
        .withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
