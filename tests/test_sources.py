"""Sources and sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.plans import REGISTRY
from quernstone.session import scratch, settings
from quernstone.sources import SCHEMAS, ingest_csv, load, write_csv, write_partitioned


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_schema_is_the_files_schema(spark, sf_dir, con, name):
    stored = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    assert load(spark, sf_dir, name).dtypes == stored.dtypes
    assert load(spark, sf_dir, name).count() == con.sql(f"SELECT count(*) FROM {name}").fetchall()[0][0]


def test_gbk_csv(spark, tmp_path):
    # 乗, 俓 and 僜 end in the byte 0x5C, which is a backslash in ASCII
    lines = ["id,name,price", "1,上海酒店,12.50", '2,"乗,俓",0', "3,a\\b僜,", "4,,1"]
    (tmp_path / "in.csv").write_bytes("\n".join(lines).encode("gbk"))
    target = str(tmp_path / "out")
    got = ingest_csv(
        spark, str(tmp_path / "in.csv"), target, "id int, name string, price decimal(9,2)", "GBK"
    )
    assert [(r.id, r.name, None if r.price is None else float(r.price)) for r in got.orderBy("id").collect()] == [
        (1, "上海酒店", 12.5),
        (2, "乗,俓", 0.0),
        (3, "a\\b僜", None),
        (4, None, 1.0),
    ]


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("id,name\nx,酒店\n".encode("gbk"))
    with pytest.raises(Exception, match="MALFORMED"):
        ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "id int, name string", "GBK")


def test_text_outside_the_charset_is_not_written(spark, tmp_path):
    for text in ("x😀y", "ñ", "two\nlines"):
        df = spark.createDataFrame([(1, text)], "id int, t string")
        with pytest.raises(Exception):
            write_csv(df, str(tmp_path / "csv"), "GBK")
    write_csv(df.select("id"), str(tmp_path / "csv"), "GBK")


def test_bytes_of_another_charset_fail(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b"id,name\n1,\xff\xfe\x81\n")
    with pytest.raises(Exception, match="unreadable bytes"):
        ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "id int, name string", "GBK")


def test_other_header_fails(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b"b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "a int, b int", "GBK")


def test_csv_bytes_are_gbk(spark, tmp_path):
    df = spark.createDataFrame([("标准",)], "t string").coalesce(1)
    write_csv(df, str(tmp_path / "csv"), "GBK")
    data = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv"))
    assert data.decode("gbk").split() == ["t", "标准"]


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).select(F.col("id"), (F.col("id") % 3).cast("int").alias("p"))
    write_partitioned(df, path, ["p"])
    write_partitioned(df.filter("p = 1").select((F.col("id") + 100).alias("id"), "p"), path, ["p"])
    got = sorted((r.p, r.id) for r in spark.read.parquet(path).collect())
    assert got == sorted((i % 3, i + 100 if i % 3 == 1 else i) for i in range(10))


def test_settings_are_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError):
        with settings(spark, spark__sql__shuffle__partitions="3", spark__some__new="x"):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
            1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.some.new", None) is None


def test_scratch_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch(spark, "a"), scratch(spark, "a")
    assert first != second and "/a-" in first
    assert root is None or first.startswith(f"{root}/a-")


class _Cluster:
    """Just enough of a session to look like a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "yarn"


def test_scratch_refuses_a_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(_Cluster(), "a")


def test_queries_read_only_the_columns_they_need(spark, sf_dir):
    plan = REGISTRY["discount_revenue"].run(spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "l_comment" not in plan and "l_partkey:bigint" not in plan.split("ReadSchema")[-1]
