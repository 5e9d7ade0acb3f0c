"""Filters, aggregates and ranking over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import exact_sum, hundredths, shifted
from quernstone.operators import exact_percentiles, top_k_per_key, weighted_sample
from quernstone.plans.registry import query
from quernstone.sources import load

#: The types with a column of their own; events of any other type, or none, count as "other".
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    """
    SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                    * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """
)
def discount_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = F.col("l_shipdate")
    return (
        load(spark, sf_dir, "lineitem")
        .filter(
            (shipped >= F.lit("1996-01-01").cast("timestamp_ntz"))
            & (shipped < F.lit("1997-01-01").cast("timestamp_ntz"))
            & F.col("l_discount").between(0.05, 0.07)
            & (F.col("l_quantity") < 24)
        )
        .agg(
            shifted(exact_sum(hundredths("l_extendedprice") * hundredths("l_discount")), 4).alias(
                "revenue"
            )
        )
    )


@query(
    """
    WITH l AS (
        SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(12,2)) AS q,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS p,
               CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02')
    SELECT l_returnflag, l_linestatus,
           CAST(sum(q) AS DOUBLE) AS sum_qty,
           CAST(sum(p) AS DOUBLE) AS sum_base_price,
           CAST(sum(p * (1 - d)) AS DOUBLE) AS sum_disc_price,
           CAST(round(sum(p * (1 - d) * (1 + t)), 2) AS DOUBLE) AS sum_charge,
           CAST(sum(q) AS DOUBLE) / count(*) AS avg_qty,
           CAST(sum(p) AS DOUBLE) / count(*) AS avg_price,
           CAST(sum(d) AS DOUBLE) / count(*) AS avg_disc,
           count(*) AS count_order
    FROM l GROUP BY ALL
    """
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = hundredths("l_extendedprice")
    discounted = price * (100 - hundredths("l_discount"))
    n = F.count("*")

    def total(column, places=2, rounded=None):
        return shifted(exact_sum(column), places, rounded)

    return (
        load(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(hundredths("l_quantity")).alias("sum_qty"),
            total(price).alias("sum_base_price"),
            total(discounted, 4).alias("sum_disc_price"),
            total(discounted * (100 + hundredths("l_tax")), 6, 2).alias("sum_charge"),
            (total(hundredths("l_quantity")) / n).alias("avg_qty"),
            (total(price) / n).alias("avg_price"),
            (total(hundredths("l_discount")) / n).alias("avg_disc"),
            n.alias("count_order"),
        )
    )


_GROUPING = """
    SELECT o_orderstatus, o_orderpriority,
           CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level,
           count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_price
    FROM orders GROUP BY {}
"""


def _by_status_and_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The finest level once; subtotals then multiply these few rows, not the orders.
    return (
        load(spark, sf_dir, "orders")
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(F.count("*").alias("n"), exact_sum(hundredths("o_totalprice")).alias("price"))
    )


def _subtotals(grouped) -> DataFrame:
    return grouped.agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("n_orders"),
        shifted(F.sum("price"), 2).alias("total_price"),
    )


@query(_GROUPING.format("ROLLUP (o_orderstatus, o_orderpriority)"))
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subtotals(
        _by_status_and_priority(spark, sf_dir).rollup("o_orderstatus", "o_orderpriority")
    )


@query(_GROUPING.format("CUBE (o_orderstatus, o_orderpriority)"))
def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subtotals(
        _by_status_and_priority(spark, sf_dir).cube("o_orderstatus", "o_orderpriority")
    )


@query(_GROUPING.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def orders_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return _subtotals(
        _by_status_and_priority(spark, sf_dir).groupingSets(
            [[status], [priority], []], status, priority
        )
    )


@query(
    """
    SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """
)
def segment_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row per customer before the join: a hot customer cannot skew it, and few rows
    # are left to count distinct, first within each input partition.
    per_customer = (
        load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    )
    return (
        load(spark, sf_dir, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.sum("n").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))
    )


@query(
    """
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.9), 6) AS p90,
           round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY event_type
    """
)
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = exact_percentiles(load(spark, sf_dir, "events"), ["event_type"], "value", shares)
    return found.select("event_type", *[F.round(name, 6).alias(name) for name in shares])


@query(
    """
    SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click,
           count(*) FILTER (event_type = 'error') AS n_error,
           count(*) FILTER (event_type = 'purchase') AS n_purchase,
           count(*) FILTER (event_type = 'signup') AS n_signup,
           count(*) FILTER (event_type = 'view') AS n_view,
           count(*) - count(*) FILTER (event_type IN ('click', 'error', 'purchase', 'signup', 'view'))
             AS n_other
    FROM events GROUP BY user_id
    """
)
def user_event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise("other")
    columns = [*EVENT_TYPES, "other"]
    pivoted = (
        load(spark, sf_dir, "events")
        .groupBy("user_id", known.alias("kind"))
        .agg(F.count("*").alias("n"))  # counted before the pivot, so any type is one row
        .groupBy("user_id")
        .pivot("kind", columns)
        .sum("n")
    )
    return pivoted.select(
        "user_id", *[F.coalesce(F.col(t), F.lit(0)).alias(f"n_{t}") for t in columns]
    )


@query(
    """
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey
                                     ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders) WHERE rank <= 3
    """
)
def top3_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    """
    WITH timed AS (
      SELECT o_orderpriority, o_orderkey, o_totalprice,
             -ln((CAST('0x' || substr(md5('1:' || o_orderkey), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                 / 4503599627370496::DOUBLE) / o_totalprice AS t
      FROM orders WHERE o_totalprice > 0 AND isfinite(o_totalprice) AND o_orderkey IS NOT NULL
    )
    SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY t, o_orderkey) AS rank
      FROM timed) WHERE rank <= 200
    """
)
def weighted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 orders of each priority, drawn in proportion to their price."""
    orders = load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return weighted_sample(orders, ["o_orderpriority"], "o_orderkey", "o_totalprice", 200)
