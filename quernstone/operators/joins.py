"""As-of and interval joins, built from unions, windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.functions import floor_micros
from quernstone.operators.hot_keys import ROWS_PER_SLICE, cut_keys, in_slices

_SEED, _RIGHT, _LEFT = 0, 1, 2


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    tie_break: list[str] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Each left row with the latest right row of the same ``by`` at or before ``left_ts``.

    Keeps all left rows; right columns are NULL without a match. Among right rows
    with equal time, the greatest ``tie_break`` wins. The two sides are unioned
    and scanned in time order, in slices of bounded size; no pairs are formed. A slice
    that continues a key starts with a seed row: the last right row before it.
    """
    ties = tie_break or []
    right = right.filter(
        " AND ".join(f"`{c}` IS NOT NULL" for c in [*by, right_ts])
    )
    right_fields = [c for c in right.columns if c not in by]
    clash = set(right_fields) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    left_type = T.StructType([left.schema[c] for c in left.columns])
    right_type = T.StructType([right.schema[c] for c in right_fields])

    rows = left.select(
        *by,
        F.col(left_ts).alias("_t"),
        F.lit(_LEFT).alias("_side"),
        F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(right_type).alias("_r"),
    ).unionByName(
        right.select(
            *by,
            F.col(right_ts).alias("_t"),
            F.lit(_RIGHT).alias("_side"),
            F.lit(None).cast(left_type).alias("_l"),
            F.struct(*right_fields).alias("_r"),
        )
    )
    rank = [F.col("_t"), F.col("_side"), *[F.col(f"_r.{c}") for c in ties]]
    # the counter also cuts rows that are equal in all of these
    rows = rows.withColumn("_nth", F.monotonically_increasing_id())
    rows = in_slices(rows, by, [*rank, F.col("_nth")], rows_per_slice).drop("_nth")
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.struct("_t", *rank[2:])
    seeds = (
        cut_keys(rows, by)
        .groupBy(*by, "_slice")
        .agg(F.max_by("_r", F.when(F.col("_side") == _RIGHT, latest)).alias("_r"))
        .withColumn("_r", F.last("_r", ignorenulls=True).over(before))
        .filter("_r IS NOT NULL")
        .select(
            *by,
            F.lit(None).cast(left.schema[left_ts].dataType).alias("_t"),
            F.lit(_SEED).alias("_side"),
            F.lit(None).cast(left_type).alias("_l"),
            "_r",
            "_slice",
        )
    )
    rows = rows.unionByName(seeds)

    upto = (
        Window.partitionBy(*by, "_slice")
        .orderBy(
            F.col("_t").asc_nulls_first(), "_side", *[F.col(f"_r.{c}").asc_nulls_first() for c in ties]
        )
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_r", F.last("_r", ignorenulls=True).over(upto))
        .filter(F.col("_side") == _LEFT)
        .select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in right_fields])
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    upper_seconds: int,
    cells: int = 1,
    salts: int = 1,
) -> DataFrame:
    """Pairs of the same ``by`` with ``left_ts < right_ts <= left_ts + upper_seconds``.

    Time is cut into cells of ``upper_seconds / cells`` that become part of the
    join key: a left row lies in one cell, a right row is offered to the cells its
    partners can lie in, so each pair is met once and a key's rows are spread over
    time. A pair can only be rejected by the time test if its rows are less than
    one cell too far apart. Works for batch sides and for streams with watermarks.

    A stream has no adaptive splitting of a hot (key, cell): with ``salts``, its left rows are
    dealt to that many tasks by their time, and right rows are offered to all of them.
    """
    width = -(-upper_seconds * 1_000_000 // cells)
    keys = [*by, "_cell", "_salt"]
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    last = floor_micros(right_ts, width)
    salt = F.pmod(F.xxhash64(left_ts), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    l = left.withColumns({"_cell": floor_micros(left_ts, width), "_salt": salt}).alias("l")
    r = right.withColumn(
        "_cell", F.explode(F.sequence(last - cells * width, last, F.lit(width)))
    )
    r = r.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0)
    ).alias("r")
    match = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    match.append(F.col(right_ts) > F.col(left_ts))
    match.append(
        F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL '{upper_seconds}' SECOND")
    )
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    rest = [F.col(f"r.{c}") for c in right.columns if c not in by]
    return l.join(r, condition).select(*[F.col(f"l.{c}") for c in left.columns], *rest)


def interval_counts(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    upper_seconds: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Each left row with ``n_matches``: how many pairs ``interval_join`` makes with it.

    No pairs are formed: the right rows of a key are counted in time order, and the
    count is read where a left row's interval opens and where it closes. The work
    grows with the rows even where the pairs grow with their square. Each left row has a
    number of its own, so equal rows keep their own counts. Rows are counted in slices
    of bounded size; a slice that continues a key starts from the total before it.
    """
    right = right.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, right_ts]))
    columns = left.columns
    left_type = T.StructType([left.schema[c] for c in columns])
    opens = F.col(left_ts)
    closes = opens + F.expr(f"INTERVAL '{upper_seconds}' SECOND")
    # both probes come from one row of one task, so they agree on its number
    probes = left.withColumn("_nth", F.monotonically_increasing_id()).select(
        *by,
        "_nth",
        F.lit(0).cast("long").alias("_add"),
        F.lit(_LEFT).alias("_side"),
        F.inline(
            F.array(
                F.struct(
                    opens.alias("_t"), F.lit(-1).alias("_sign"), F.struct(*columns).alias("_l")
                ),
                F.struct(
                    closes.alias("_t"), F.lit(1).alias("_sign"), F.lit(None).cast(left_type).alias("_l")
                ),
            )
        ),
    )
    rows = probes.unionByName(
        right.select(
            *by,
            F.monotonically_increasing_id().alias("_nth"),
            F.lit(1).cast("long").alias("_add"),
            F.lit(_RIGHT).alias("_side"),
            F.col(right_ts).alias("_t"),
            F.lit(0).alias("_sign"),
            F.lit(None).cast(left_type).alias("_l"),
        )
    )
    rows = in_slices(rows, by, [F.col("_t"), F.col("_side"), F.col("_nth")], rows_per_slice)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        cut_keys(rows, by)
        .groupBy(*by, "_slice")
        .agg(F.sum("_add").alias("_add"))
        .withColumn("_add", F.sum("_add").over(before))
        .filter("_add > 0")
        .withColumns(
            {
                "_nth": F.lit(0).cast("long"),
                "_l": F.lit(None).cast(left_type),
                "_side": F.lit(_SEED),
                "_t": F.lit(None).cast(left.schema[left_ts].dataType),
                "_sign": F.lit(0),
            }
        )
    )
    upto = (
        Window.partitionBy(*by, "_slice")
        .orderBy(F.col("_t").asc_nulls_first(), "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # only the opening probe carries the row; the closing one is narrow
    return (
        rows.unionByName(seeds)
        .withColumn("_seen", F.sum("_add").over(upto))
        .filter(F.col("_side") == _LEFT)
        .groupBy("_nth")
        .agg(
            F.first("_l", ignorenulls=True).alias("_l"),
            F.sum(F.col("_seen") * F.col("_sign")).alias("n_matches"),
        )
        .select("_l.*", "n_matches")
    )


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` as often as they are more there than in ``right``."""
    return _by_counts(left, right, lambda l, r: F.greatest(l - r, F.lit(0).cast("long")))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows as often as they are in both."""
    return _by_counts(left, right, F.least)


def _by_counts(left: DataFrame, right: DataFrame, copies, part: int = 100_000) -> DataFrame:
    """Counts, with map-side combine, instead of rows; copies are emitted by many tasks.

    A value's copies are first split into parts of bounded size, which are dealt
    evenly before they become rows.
    """
    counted = (
        left.withColumns({"_l": F.lit(1).cast("long"), "_r": F.lit(0).cast("long")})
        .unionAll(right.withColumns({"_l": F.lit(0).cast("long"), "_r": F.lit(1).cast("long")}))
        .groupBy(*left.columns)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .withColumn("_n", copies(F.col("_l"), F.col("_r")))
        .filter("_n > 0")
    )
    parts = counted.select(
        *left.columns,
        "_n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / part))).alias("_part"),
    )
    size = F.least(F.lit(part).cast("long"), F.col("_n") - F.col("_part") * part)
    dealt = parts.select(*left.columns, size.alias("_size")).repartition(
        int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_size"))).select(
        *left.columns
    )
