"""Operators 8 and 10: exact top-k by tiled products, and a forest of hash prefixes.

Vectors that are NULL or empty, hold NULL or non-finite components, or have no id
take no part. All others must have one length; a second length is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import written

#: Rows of one tile; a task works on one tile of queries and one of rows.
TILE = 4_096
#: Rows of the largest tile of an exact search, 16 MB for 64 components: a row is copied once for so
#: many queries, a query once for so many rows.
WIDE = 32_768
#: Scores that a task holds at once.
SCORES = 4_194_304
#: Lists that one task merges.
FAN_IN = 4


def usable(vector: Column) -> Column:
    """Not NULL, not empty, every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _prepared(vectors: DataFrame, queries: DataFrame, component, label: str):
    """Both sides written, as ``id, v``; a repeated query id counts once, with its least vector."""

    def fit(df: DataFrame) -> DataFrame:
        return df.where(F.col("id").isNotNull() & usable(F.col("v"))).select(
            F.col("id").cast("long"), F.transform("v", component).alias("v")
        )

    rows = written(fit(vectors), f"{label}-rows")
    asked = written(fit(queries).groupBy("id").agg(F.min("v").alias("v")), f"{label}-queries")
    sizes = rows.unionAll(asked).agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    return rows, asked, sizes[0] or 1


class Tiles:
    """Rows and queries cut into tiles; ``each`` runs a function on every pair of tiles.

    A hash deals the rows, so a tile holds about ``tile`` rows whatever their values.
    A row goes to each tile of queries, a query to each tile of rows: blocks, in
    which a task looks at two bounded tables.
    """

    def __init__(self, rows: DataFrame, asked: DataFrame, tile: int):
        self.n_rows = max(1, -(-rows.count() // tile))
        self.n_asked = max(1, -(-asked.count() // tile))
        self.rows = self._dealt(rows, "row_tile", self.n_rows, "query_tile", self.n_asked)
        self.asked = self._dealt(asked, "query_tile", self.n_asked, "row_tile", self.n_rows)

    @staticmethod
    def _dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # the counter spreads repeated rows; it is fixed, since the table is written
        salt = F.xxhash64("id", F.monotonically_increasing_id())
        return df.withColumn(own, F.pmod(salt, F.lit(n)).cast("long")).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        )

    def each(self, run, schema: str, asked: DataFrame | None = None) -> DataFrame:
        """``run(queries, rows) -> frame`` on each pair; the result also has both tile numbers."""
        asked = self.asked if asked is None else asked

        def with_tiles(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = run(queries, rows) if len(queries) and len(rows) else pd.DataFrame()
            if not len(out):
                return pd.DataFrame()
            return out.assign(query_tile=key[0], row_tile=key[1])

        keys = ["query_tile", "row_tile"]
        return (
            asked.groupBy(*keys).cogroup(self.rows.groupBy(*keys))
            .applyInPandas(with_tiles, f"{schema}, query_tile long, row_tile long")
        )

    def best(self, lists: DataFrame, k: int, kind: str) -> DataFrame:
        """The ``k`` best of each query's lists, merged ``FAN_IN`` at a time like a tree."""
        schema = f"query_id long, vec_id long, score {kind}, query_tile long, row_tile long"

        def merged(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.iloc[np.lexsort((pdf["vec_id"], -pdf["score"], pdf["query_id"]))]
            return pdf[pdf.groupby("query_id").cumcount() < k]

        n = self.n_rows
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            lists = lists.withColumn("row_tile", F.floor(F.col("row_tile") / FAN_IN))
            lists = lists.groupBy("query_tile", "row_tile").applyInPandas(merged, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, ties to the smaller id; partial selection before the sort."""
    places = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        places = np.flatnonzero(scores >= least)
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _exact_product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number products: in doubles while every partial sum stays exact, else in integers."""
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**53:
        return (q @ v.T).astype("i8")
    whole = [np.array([[int(c) for c in row] for row in x], dtype=object) for x in (q, v)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype("i8")


def _tile(rows: DataFrame) -> int:
    """As wide as leaves a tile of rows for every shuffle partition, between ``TILE`` and ``WIDE``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(WIDE, max(TILE, -(-rows.count() // partitions)))


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0,
    tile: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products.

    ``vectors`` and ``queries`` have ``id, v`` (array of numbers); a component x counts as
    ``floor(scale * x)``. A score beyond 64 bits stays at their limit. A query never meets
    rows of its own id; ties go to the smaller id; a repeated candidate row appears as
    often as it occurs. Fewer than ``k`` candidates give fewer rows, empty tables none.

    ``tile`` is the number of rows, and of queries, of a tile (see ``_tile`` if not given); a task
    multiplies a tile of rows by as many of the queries at a time as ``SCORES`` allows.
    """
    rows, asked, _ = _prepared(
        vectors, queries, lambda x: F.floor(x.cast("double") * scale).cast("double"), "topk"
    )
    tiles = Tiles(rows, asked, tile or _tile(rows))

    def products(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        ids, own = rows["id"].to_numpy("i8"), queries["id"].to_numpy("i8")
        q, v = np.stack(queries["v"]), np.stack(rows["v"])
        block, out = max(1, SCORES // len(ids)), []
        for at in range(0, len(own), block):
            scores = _exact_product(q[at : at + block], v)
            for query, line in zip(own[at : at + block], scores, strict=True):
                others = np.flatnonzero(ids != query)
                best = others[_top(ids[others], line[others], k)]
                out.append(np.array([np.full(len(best), query), ids[best], line[best]]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["query_id", "vec_id", "score"])

    lists = tiles.each(products, "query_id long, vec_id long, score long")
    return tiles.best(lists, k, "long")


class Forest:
    """Hash strings of vectors, ``trees`` times ``bits`` signs of random projections."""

    def __init__(self, size: int, trees: int, bits: int, seed: int):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees, size, bits))
        self.powers = 1 << np.arange(bits - 1, -1, -1, dtype="i8")

    def codes(self, v: np.ndarray) -> np.ndarray:
        """``codes[t, i]``: the string of vector i in tree t, first bit highest."""
        return np.stack([(v @ p > 0) @ self.powers for p in self.planes])

    def ranges(self, sorted_codes: np.ndarray, asked: np.ndarray, level) -> tuple:
        """Where the strings stand that share their first ``level`` bits with ``asked``."""
        low = asked >> (self.bits - level) << (self.bits - level)
        high = low + (1 << (self.bits - level))
        return np.searchsorted(sorted_codes, low), np.searchsorted(sorted_codes, high)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 128, bits: int = 24,
    share: float = 0.4, least: int = 0, tile: int = TILE, seed: int = 10,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest cosines among the found candidates.

    Each tree keeps the rows' hash strings sorted. A query descends every tree to the
    rows with its longest prefix; then all trees ascend together, one bit at a time,
    until the ranges of that prefix length hold ``max(least, share * rows + trees)`` entries, counted over
    all trees. All rows in these ranges are compared exactly, in doubles. The
    counts are summed over all tiles before the length is chosen, so the result is
    that of one forest over the whole table. A query with fewer than ``k`` rows in its ranges
    is compared with all rows.

    Vectors of length zero take no part either. Of equal vectors only the ``k + 1``
    smallest distinct ids are indexed, each at most ``k`` times: by the rule for ties no
    query returns another. Ties go to
    the smaller id; a query never meets its own id; empty tables give no rows.
    """
    rows, asked, size = _prepared(
        vectors.where(_length("v") > 0), queries.where(_length("v") > 0),
        lambda x: x.cast("double"), "forest",
    )
    copies = Window.partitionBy("v", "id").orderBy("id")
    equal = Window.partitionBy("v").orderBy("id")
    total = rows.count()
    rows = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k)
    rows = rows.withColumn("nth", F.dense_rank().over(equal)).where(F.col("nth") <= k + 1)
    rows = written(rows.select("id", "v"), "forest-distinct")
    tiles = Tiles(rows, asked, tile)
    enough = max(least, share * total + trees)  # a query has a place of its own in every tree

    def levels(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(size, trees, bits, seed)
        v, q = forest.codes(np.stack(rows["v"])), forest.codes(np.stack(queries["v"]))
        found = np.zeros((len(queries), bits + 1), "i8")
        for t in range(trees):
            order = np.sort(v[t])
            for level in range(bits + 1):
                low, high = forest.ranges(order, q[t], level)
                found[:, level] += high - low
        return pd.DataFrame({"query_id": queries["id"], "found": list(found)})

    counted = tiles.each(levels, "query_id long, found array<long>").groupBy("query_id").agg(
        F.array(*[F.sum(F.col("found")[i]) for i in range(bits + 1)]).alias("found")
    )
    level = F.size(F.filter("found", lambda n: n >= enough)) - 1
    counted = written(
        counted.select("query_id", F.greatest(level, F.lit(0)).alias("level")), "forest-levels"
    )
    levelled = tiles.asked.join(counted.withColumnRenamed("query_id", "id"), "id")

    def compared(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(size, trees, bits, seed)
        a, b = np.stack(queries["v"]), np.stack(rows["v"])
        ids, own = rows["id"].to_numpy("i8"), queries["id"].to_numpy("i8")
        depth = queries["level"].to_numpy("i8")
        v, q = forest.codes(b), forest.codes(a)
        order = np.argsort(v, axis=1, kind="stable")
        spans = [forest.ranges(v[t][order[t]], q[t], depth) for t in range(trees)]
        lengths, out = np.sqrt((b * b).sum(axis=1)), []
        for i, query in enumerate(own):
            hit = np.zeros(len(ids), bool)
            for t in range(trees):
                hit[order[t, spans[t][0][i] : spans[t][1][i]]] = True
            hit &= ids != query
            near = np.flatnonzero(hit)
            if not len(near):
                continue
            score = (b[near] * a[i]).sum(axis=1) / (lengths[near] * np.sqrt((a[i] * a[i]).sum()))
            best = _top(ids[near], score, k)
            out.append(pd.DataFrame(
                {"query_id": query, "vec_id": ids[near[best]], "score": score[best]}
            ))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()

    def found_by(asked: DataFrame) -> DataFrame:
        lists = tiles.each(compared, "query_id long, vec_id long, score double", asked)
        return tiles.best(lists, k, "double")

    found = written(found_by(levelled), "forest-found")
    full = found.where(F.col("rank") == k).select("query_id")
    short = written(counted.select("query_id").join(full, "query_id", "left_anti"), "forest-short")
    if short.isEmpty():
        return found
    again = tiles.asked.join(short.withColumnRenamed("query_id", "id"), "id")
    rest = found_by(again.withColumn("level", F.lit(0).cast("long")))
    return found.join(short, "query_id", "left_anti").unionByName(rest)


def _length(vector: str) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(squares, F.lit(0.0))
