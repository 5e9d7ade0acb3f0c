"""Operator 13: Lloyd's clustering with the dimensions dealt out to shards.

Vectors lie in batches, and a batch in column blocks, one for each shard. A task that
holds a block knows only its shard's slice of every centroid: it computes exact partial
squared distances, ``reduceByKey`` adds the blocks of a batch, and the least sum decides. The
assignments then go back to the blocks, and every shard adds up its own columns and
moves its own slices. Everything is whole numbers, so no sum depends on an order.

What the driver holds is the centroids: ``k`` times the number of dimensions.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import row_ids, written
from quernstone.llm.vectors import usable

#: Vectors of one batch, and shards that the dimensions are dealt to.
BATCH = 4_096
SHARDS = 4
#: The block that holds a batch's ids.
_IDS = -1


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of doubles, exact; Python integers where 53 bits are too few."""
    with np.errstate(over="ignore"):
        scaled = np.floor(v * scale)
    if np.abs(scaled).max(initial=0) < 2.0**53:
        return narrow(scaled.astype("i8"))
    exact = [
        [int(s) if math.isfinite(s) else int(x) * int(scale) for s, x in zip(row, at, strict=True)]
        for row, at in zip(scaled.tolist(), v.tolist(), strict=True)
    ]
    return np.array(exact, dtype=object).reshape(v.shape)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    if not a.size:
        return a.astype("u1")
    low, high = int(a.min()), int(a.max())
    if low < -(2**63) or high >= 2**63:
        return a
    return a.astype(np.result_type(np.min_scalar_type(low), np.min_scalar_type(high)))


def partial_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centroid over the given columns."""
    top = max(abs(int(m)) for a in (x, centers) for m in (a.min(), a.max()))
    if 4 * top * top * x.shape[1] < 2**53:  # every partial sum is exact in doubles
        a, b = x.astype("f8"), centers.astype("f8")
        squares = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return narrow(squares.astype("i8"))
    apart = x.astype(object)[:, None, :] - centers.astype(object)[None]
    return narrow((apart * apart).sum(axis=2))


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elementwise sum that never overflows."""
    low, high = (int(getattr(a, f)()) + int(getattr(b, f)()) for f in ("min", "max"))
    kind = "i8" if low >= -(2**63) and high < 2**63 else object
    return narrow(a.astype(kind) + b.astype(kind))


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and counts of each cluster's rows."""
    kind = "i8" if x.dtype != object else object
    if kind == "i8" and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 2**63:
        kind = object
    sums = np.zeros((k, x.shape[1]), kind)
    np.add.at(sums, cluster, x.astype(kind))
    return sums, np.bincount(cluster, minlength=k).astype("i8")


def _blocks(shards: list[np.ndarray], size: int, scale: float, rows: int):
    """Batches of at most ``rows`` vectors as one block per shard, and one with their ids."""
    schema = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])

    def run(batches):
        number = row_ids()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids, lists = part.column(0), part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                x = whole(flat.reshape(len(ids), size), scale)
                out = [(_IDS, ids.to_pylist()), *((s, narrow(x[:, c])) for s, c in enumerate(shards))]
                n = next(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(out), pa.int64()),
                     pa.array([s for s, _ in out], pa.int32()),
                     pa.array([pickle.dumps(d) for _, d in out], pa.binary())],
                    schema=schema,
                )

    return run


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64,
    k: int = 16, rounds: int = 3, scale: float = 64.0, seed: str = "1", shards: int = SHARDS,
    batch: int = BATCH,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors with exactly ``size`` components, none NULL or not finite, are kept; a component
    x counts as ``floor(scale * x)``. Centroids start as the ``k`` kept vectors with the smallest
    SHA-256 of ``seed:id`` (equal ids: the smaller vector first; NULL ids after all others). Each round
    assigns every vector to the nearest centroid (ties: the smaller number) and moves every
    non-empty centroid to its vectors' componentwise ``floor(sum / count)``; one more
    assignment ends it. Repeated rows count as often as they occur and NULL ids are kept. With
    fewer than ``k`` vectors there are fewer centroids, with none no rows. Distances are
    exact; those beyond 64 bits are shown as the largest 64-bit number.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kept = kept.where(usable(F.col("v")) & (F.size("v") == size)).withColumn(
        "v", F.transform("v", lambda x: x.cast("double"))
    )
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(by_hash.asc_nulls_last(), "v").limit(k).collect()
    schema = (
        "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
        "centroid_sha256 string"
    )
    if not first:
        return spark.createDataFrame([], schema)
    start = whole(np.array([r["v"] for r in first]), scale)
    columns = [c for c in np.array_split(np.arange(size), shards) if len(c)]
    centers = [narrow(start[:, c]) for c in columns]
    k = len(start)

    blocks = written(
        kept.mapInArrow(_blocks(columns, size, scale, batch), "batch long, shard int, data binary"),
        "column-blocks",
    )
    batches = blocks.where(F.col("shard") == _IDS)
    held = batches.count()
    ours = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(ours, held), -(-held // 256))
    slices = (
        blocks.where(F.col("shard") != _IDS).rdd
        .map(lambda r: (r["batch"], (r["shard"], pickle.loads(r["data"]))))
    )

    def distances():
        here = list(centers)
        return slices.mapValues(lambda s: partial_distances(s[1], here[s[0]])).reduceByKey(
            added, tasks
        )

    for _ in range(rounds):
        nearest = distances().mapValues(lambda d: narrow(d.argmin(axis=1)))
        # (shard, its columns) meets the batch's assignments; each shard sums its own columns
        moved = (
            slices.join(nearest, tasks)
            .map(lambda b: (b[1][0][0], _sums(b[1][0][1], b[1][1], k)))
            .reduceByKey(lambda a, b: (added(a[0], b[0]), a[1] + b[1]), len(columns))
            .mapValues(lambda s: (s[0].astype(object), s[1]))
            .collect()
        )
        for shard, (sums, counts) in moved:
            old = centers[shard].astype(object)
            new = [s // int(n) if n else o for s, n, o in zip(sums, counts, old, strict=True)]
            centers[shard] = narrow(np.array(new, dtype=object).reshape(old.shape))

    found = distances().map(
        lambda b: (b[0], pickle.dumps((narrow(b[1].argmin(axis=1)), b[1].min(axis=1))))
    )
    found = written(
        spark.createDataFrame(found, "batch long, found binary", verifySchema=False), "assigned"
    )

    def each(parts):
        most = 2**63 - 1
        out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
        for part in parts:
            for ids, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                cluster, distance = pickle.loads(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pickle.loads(ids), pa.int64()),
                     pa.array(cluster.astype("i4"), pa.int32()),
                     pa.array([min(int(d), most) for d in distance], pa.int64())],
                    schema=out,
                )

    rows = written(
        batches.select("batch", "data").join(found, "batch").select("data", "found")
        .mapInArrow(each, "vec_id long, cluster int, distance long"),
        "clustered",
    )
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    total = sum(int(s) for _, s in sums)
    whole_centers = np.concatenate([c.astype(object) for c in centers], axis=1)
    names = [
        hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in whole_centers
    ]

    def per_cluster(values: dict):
        pairs = [F.lit(x) for item in values.items() for x in item]
        return F.element_at(F.create_map(*pairs), F.col("cluster"))

    most = 2**63 - 1
    return rows.select(
        "vec_id", "cluster", "distance",
        per_cluster({int(c): min(int(s), most) for c, s in sums}).cast("long").alias("cluster_inertia"),
        F.lit(min(total, most)).cast("long").alias("inertia"),
        per_cluster({int(c): names[c] for c, _ in sums}).alias("centroid_sha256"),
    )
