"""Star, semi and anti joins over the order tables.

No broadcast hints: Spark broadcasts a dimension only while its measured size is
below the threshold, and otherwise sort-merges, where adaptive execution splits
partitions of hot keys. Lines are reduced to one row per order before they meet
the orders; the aggregate's partitioning is the join's, so this adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import exact_sum, hundredths, shifted
from quernstone.operators import except_all, intersect_all
from quernstone.plans.registry import query
from quernstone.sources import load


@query(
    """
    SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL
    """
)
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(hundredths("l_extendedprice") * (100 - hundredths("l_discount"))).alias("revenue")
        )
    )
    places = (
        load(spark, sf_dir, "customer")
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "n_name", "r_name")
    )
    return (
        load(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        # one row per customer and year meets the customers, not one per order
        .groupBy("o_custkey", "o_year")
        .agg(exact_sum(F.col("revenue")).alias("revenue"))
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("r_name", "n_name", "o_year")
        .agg(shifted(F.sum("revenue"), 4).alias("revenue"))
    )


@query(
    """
    SELECT * FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """
)
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_lines = load(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return load(spark, sf_dir, "orders").join(
        with_lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"
    )


@query(
    """
    SELECT * FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    """
)
def orders_with_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = (
        load(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select("l_orderkey")
        .distinct()
    )
    return load(spark, sf_dir, "orders").join(
        returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"
    )


def _nations(spark: SparkSession, sf_dir: str, table: str, column: str) -> DataFrame:
    return load(spark, sf_dir, table).select(F.col(column).alias("nationkey"))


@query(
    """
    SELECT c_nationkey AS nationkey FROM customer
    UNION SELECT s_nationkey FROM supplier
    """
)
def nation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _nations(spark, sf_dir, "customer", "c_nationkey")
    suppliers = _nations(spark, sf_dir, "supplier", "s_nationkey")
    return customers.union(suppliers).distinct()


@query(
    """
    SELECT c_nationkey AS nationkey FROM customer
    INTERSECT SELECT s_nationkey FROM supplier
    """
)
def nation_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct first: otherwise every customer row is shuffled to the semi join
    customers = _nations(spark, sf_dir, "customer", "c_nationkey").distinct()
    suppliers = _nations(spark, sf_dir, "supplier", "s_nationkey").distinct()
    return customers.intersect(suppliers)


@query(
    """
    SELECT c_nationkey AS nationkey FROM customer
    EXCEPT ALL SELECT s_nationkey FROM supplier
    """
)
def nation_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _nations(spark, sf_dir, "customer", "c_nationkey")
    return except_all(customers, _nations(spark, sf_dir, "supplier", "s_nationkey"))


@query(
    """
    SELECT c_nationkey AS nationkey FROM customer
    INTERSECT ALL SELECT s_nationkey FROM supplier
    """
)
def nation_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _nations(spark, sf_dir, "customer", "c_nationkey")
    return intersect_all(customers, _nations(spark, sf_dir, "supplier", "s_nationkey"))
