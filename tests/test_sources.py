from __future__ import annotations

import pytest
from plans import physical
from pyspark.sql import functions as F

from cartsight.operators import delivery, geo
from cartsight.operators.joins import join_facts
from cartsight.session import sized_settings
from cartsight.sources import FileStore, TableStore, materialise, shared_folder, store_and_read
from cartsight.sources.schemas import COMMERCE


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_file_store(spark, sample, tmp_path, fmt):
    """The commerce tables as files of their own give the same results as the derived ones."""
    for name, df in sample.tables().items():
        typed = df.select([F.col(f.name).cast(f.dataType) for f in COMMERCE[name]])
        path = str(tmp_path / f"{name}.{fmt}")
        if fmt == "csv":
            shuffled = [F.lit("extra").alias("unused"), *reversed(typed.columns)]
            typed.select(*shuffled).write.option("header", True).csv(path)
        else:
            typed.write.parquet(path)
    store = FileStore(spark, str(tmp_path), fmt)
    for name, df in store.tables().items():
        assert df.schema == COMMERCE[name], name
    assert delivery.delay_stats(store.orders).first() == delivery.delay_stats(sample.orders).first()

    def routes(s):
        args = (s.order_items, s.orders, s.customers, s.sellers, geo.centroid_by_key(s.geolocation))
        return geo.top_routes(geo.shipments(*args)).collect()

    assert routes(store) == routes(sample)


def test_bucketed_tables_join_without_a_shuffle(spark, sample):
    spark.sql("CREATE DATABASE shop")
    for name in ("orders", "order_items"):
        materialise(getattr(sample, name), f"shop.{name}", bucket_by="order_id", buckets=8)
    store = TableStore(spark, "shop")
    joined = join_facts(store.order_items, store.orders, "order_id")
    plan = physical(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 60000
    spark.sql("DROP DATABASE shop CASCADE")


def test_views(spark, sample):
    sample.create_views()
    (n,) = spark.sql("SELECT count(*) FROM order_items JOIN orders USING (order_id)").first()
    assert n == 60000


def test_materialise(spark):
    df = spark.range(5)
    assert materialise(df, "numbers").count() == 5
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        materialise(df, "numbers")
    assert materialise(spark.range(3), "numbers", mode="overwrite").count() == 3
    spark.sql("DROP TABLE numbers")


def test_materialise_over_the_table_it_reads(spark):
    """Adding a computed column to a stored table, in place of an update."""
    materialise(spark.createDataFrame([(1.0,), (-9.0,)], "DeliveryDelayDays double"), "shipped")
    changed = geo.with_delay_category(spark.table("shipped"))
    stored = materialise(changed, "shipped", mode="overwrite")
    kinds = {r["DelayCategory"] for r in stored.collect()}
    assert kinds == {"Delayed", "Early (5+ days early)"}
    names = [t.name for t in spark.catalog.listTables()]
    assert [n for n in names if n.startswith("shipped")] == ["shipped"]
    spark.sql("DROP TABLE shipped")


def test_failed_overwrite_leaves_the_table(spark):
    materialise(spark.range(4), "kept")
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        materialise(broken, "kept", mode="overwrite")
    assert spark.table("kept").count() == 4
    spark.sql("DROP TABLE kept")


def test_shared_folder(spark, settings):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = store_and_read(spark.range(3), "three")
    assert stored.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(
        shared_folder(spark).lstrip("/")
    )
    assert stored.count() == 3
    assert store_and_read(spark.range(4), "three").count() == 4
    assert stored.count() == 3


def test_settings_follow_the_data():
    small = sized_settings(40 * 1024**2, 8)
    large = sized_settings(100 * 1024**4, 8000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert large["spark.sql.shuffle.partitions"] == "40960"
    assert large["spark.sql.files.maxPartitionBytes"] == "512m"
