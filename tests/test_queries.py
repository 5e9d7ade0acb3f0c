"""Every registered query against its SQL, and proof that the comparison can fail."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import difference, rows_of
from quernstone.plans import REGISTRY
from quernstone.sources import load


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_matches_sql(spark, sf_dir, con, name):
    df = contract.queries()[name](spark, sf_dir)
    assert difference(df, con, contract.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(contract.oracle_sql())
    assert set(REGISTRY) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_changed_order_is_noticed(spark, sf_dir, con, tmp_path):
    """Doubling one order's lines must change star_revenue."""
    for name in ("orders", "customer", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    lines = load(spark, sf_dir, "lineitem")
    one = lines.filter("l_orderkey = 7")
    assert one.count() > 0
    lines.union(one).write.parquet(str(tmp_path / "lineitem.parquet"))
    changed = contract.queries()["star_revenue"](spark, str(tmp_path))
    assert difference(changed, con, contract.oracle_sql()["star_revenue"]) != ""


def test_input_order_does_not_matter(spark, sf_dir, con, tmp_path):
    """Sums are exact, so many small shuffled files give the same bits."""
    load(spark, sf_dir, "lineitem").repartition(7, "l_suppkey").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    for name in ("pricing_summary", "discount_revenue"):
        df = contract.queries()[name](spark, str(tmp_path))
        assert difference(df, con, contract.oracle_sql()[name]) == ""


def test_comparison_is_a_multiset():
    assert rows_of(["a"], [(1,), (1,)]) != rows_of(["a"], [(1,)])
    assert rows_of(["b", "a"], [(1, 2)]) == rows_of(["a", "b"], [(2, 1)])
    assert rows_of(["a"], [(0.1 + 0.2,)]) != rows_of(["a"], [(0.3,)])


def test_null_is_not_nan():
    assert rows_of(["a"], [(None,)]) != rows_of(["a"], [(float("nan"),)])
    assert rows_of(["a"], [(float("nan"),)]) == rows_of(["a"], [(float("nan"),)])


def test_distinct_customers_are_counted_not_rows(spark, sf_dir, tmp_path):
    """Every customer twice: twice the orders, as many customers."""
    customers = load(spark, sf_dir, "customer")
    customers.unionAll(customers).write.parquet(str(tmp_path / "customer.parquet"))
    (tmp_path / "orders.parquet").symlink_to(f"{sf_dir}/orders.parquet")
    once = REGISTRY["segment_distinct"].run(spark, sf_dir).collect()
    twice = REGISTRY["segment_distinct"].run(spark, str(tmp_path)).collect()
    assert sorted((r[0], 2 * r[1], r[2]) for r in once) == sorted(map(tuple, twice))


def test_events_of_other_types_are_counted(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1), 1, kind, 1.0, "{}")
            for i, kind in enumerate(["view", "refund", None, "other", "click"])]
    schema = load(spark, "/root/testdata/sf0.001", "events").schema
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    (row,) = REGISTRY["user_event_pivot"].run(spark, str(tmp_path)).collect()
    assert (row.n_view, row.n_click, row.n_other, row.n_error) == (1, 1, 3, 0)
