"""Materialised views: built once, read by many, built anew when the plan or an input changes."""

from __future__ import annotations

import os
import shutil

import pytest
from plans import physical
from pyspark.sql import functions as F

from cartsight.plans import QUERIES
from cartsight.operators import kpi
from cartsight.sources import FileStore, drop_views, shared_folder, store_view, view, view_key
from cartsight.sources import views as module

COPY = "/root/testdata/sf0.001"


def builds(spark, name):
    """Complete builds of the views of that name."""
    folder = f"{shared_folder(spark).removeprefix('file:')}/cartsight/views"
    found = [d for d, _, files in os.walk(folder) if "_SUCCESS" in files]
    return [d for d in found if os.path.basename(os.path.dirname(d)).startswith(f"{name}-")]


@pytest.fixture
def shop(tmp_path):
    """The smallest sample in a folder with an awkward name."""
    folder = tmp_path / "shop a%20b [1]"
    folder.mkdir()
    for name in os.listdir(COPY):
        if name.split(".")[0] in "region nation customer supplier part orders lineitem events".split():
            shutil.copy(f"{COPY}/{name}", folder / name)
    return str(folder)


def test_the_second_query_reads_the_table_of_the_first(spark, tmp_path):
    folder = str(tmp_path / "shop")
    shutil.copytree(COPY, folder, ignore=shutil.ignore_patterns("documents*", "pages*", "embeddings*"))
    before = len(builds(spark, "order_distance_delay"))
    QUERIES["g08_delay_by_distance_band"](spark, folder).collect()
    assert len(builds(spark, "order_distance_delay")) == before + 1
    for name in ("g09v_delayed_pct", "g12_kpi_pct", "d01_top_routes", "d02_freight_vs_distance", "d04_on_time_rate"):
        plan = physical(QUERIES[name](spark, folder))
        assert plan.count("FileScan") == 1 and "Join" not in plan, name
    assert len(builds(spark, "order_distance_delay")) == before + 1


def test_columns_are_pruned(spark, sample):
    plan = physical(QUERIES["g08_delay_by_distance_band"](spark, sample.folder))
    assert "ReadSchema: struct<DistanceKM:double,DeliveryDelayDays:double>" in plan


def table(spark, path):
    return spark.read.schema("k long, v double").parquet(path)


def test_changed_new_and_missing_files_build_anew(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(10).selectExpr("id AS k", "1.0D AS v").repartition(2).write.parquet(path)

    def total():
        name = "changing"
        return view(table(spark, path).groupBy().agg(F.sum("v").alias("s")), name).first()[0]

    some = next(f for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert total() == 10 and total() == 10
    assert len(builds(spark, "changing")) == 1
    spark.range(5).selectExpr("id AS k", "2.0D AS v").coalesce(1).write.mode("append").parquet(path)
    assert total() == 20
    lost = table(spark, f"{path}/{some}").agg(F.sum("v")).first()[0]
    kept = tmp_path / "kept"
    os.rename(f"{path}/{some}", kept)
    assert total() == 20 - lost
    os.rename(kept, f"{path}/{some}")
    assert total() == 20
    assert len(builds(spark, "changing")) == 3  # the files are as they were before the loss
    os.utime(f"{path}/{some}", (1, 1))
    assert total() == 20
    assert len(builds(spark, "changing")) == 4


def test_plans_and_settings_have_views_of_their_own(spark, settings, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(10).selectExpr("id AS k", "1.0D AS v").write.parquet(path)
    df = table(spark, path)
    keys = {
        view_key(df),
        view_key(df.where("k > 3")),
        view_key(df.where("k > 4")),
        view_key(df.select("v", "k")),
        view_key(df.withColumnRenamed("v", "w")),
        view_key(df.select("k", *[F.lit(i).alias(f"c{i}") for i in range(60)])),
        view_key(df.select("k", *[F.lit(i if i < 59 else -1).alias(f"c{i}") for i in range(60)])),
        view_key(df, version="2"),
    }
    assert len(keys) == 8
    assert view_key(table(spark, path).where("k > 3")) in keys
    settings(spark__sql__session__timeZone="Asia/Tokyo")
    assert view_key(df) not in keys


def test_names_of_files_may_be_awkward(spark, shop):
    bands = [tuple(r) for r in QUERIES["g08_delay_by_distance_band"](spark, COPY).collect()]
    path = shop.replace("[", "\\[").replace("]", "\\]")
    assert [tuple(r) for r in QUERIES["g08_delay_by_distance_band"](spark, path).collect()] == bands


def test_what_a_plan_does_not_show_needs_a_version(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(10).selectExpr("id AS k", "1.0D AS v").write.parquet(path)
    one = F.udf(lambda x: x + 1, "double")
    for df in (
        table(spark, path).select(one("v").alias("v")),
        spark.createDataFrame([(1,)], "k long"),
        table(spark, path).withColumn("at", F.current_timestamp()),
        table(spark, path).withColumn("r", F.rand()),
    ):
        with pytest.raises(ValueError, match="version"):
            view(df, "opaque")
    assert view(table(spark, path).select(one("v").alias("v")), "opaque", version="1").count() == 10


def test_a_build_that_fails_is_never_read(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(10).selectExpr("id AS k", "1.0D AS v").write.parquet(path)
    broken = table(spark, path).select(F.when(F.col("k") < 100, F.raise_error(F.lit("broken"))).cast("long").alias("k"))
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            view(broken, "broken")
    assert builds(spark, "broken") == []


def test_drop_views(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(10).selectExpr("id AS k", "1.0D AS v").write.parquet(path)
    view(table(spark, path), "gone")
    view(table(spark, path), "staying")
    drop_views(spark, "gone")
    assert builds(spark, "gone") == [] and len(builds(spark, "staying")) == 1
    assert view(table(spark, path), "gone").count() == 10


def _paid(store):
    return store.payments.groupBy("payment_type").agg(F.sum("payment_value").alias("paid"))


def write_payments(spark, folder, values, mode="overwrite"):
    rows = spark.createDataFrame([(str(i), "card", float(v)) for i, v in enumerate(values)], "order_id string, payment_type string, payment_value double")
    rows.coalesce(1).write.mode(mode).parquet(f"{folder}/payments.parquet")


def test_a_known_view_is_neither_planned_nor_built(spark, tmp_path):
    folder = str(tmp_path)
    write_payments(spark, folder, [1, 2])
    calls = []

    def build(store):
        calls.append(store)
        return _paid(store)

    read = lambda: store_view(FileStore(spark, folder), build, "paid").first().paid
    assert read() == 3 and len(calls) == 2  # for its plan, and to build it
    assert read() == 3 and len(calls) == 2
    write_payments(spark, folder, [10], mode="append")
    assert read() == 13 and len(calls) == 3
    assert len(builds(spark, "paid")) == 2


def test_a_stale_store_gives_a_fresh_view(spark, tmp_path):
    folder = str(tmp_path)
    write_payments(spark, folder, [1, 2])
    store = FileStore(spark, folder)
    assert store.payments.count() == 2  # the store has listed its files
    write_payments(spark, folder, [5, 6, 7])
    assert store_view(store, _paid, "stale").first().paid == 18


def test_inputs_that_change_during_a_build(spark, tmp_path):
    folder = str(tmp_path)
    write_payments(spark, folder, [1, 2])
    late = [[10], [20]]

    def build(store):
        df = _paid(store)
        if late and (module._KNOWN.keys() & {k for k in module._KNOWN if k[1] is build}):
            write_payments(spark, folder, late.pop(), mode="append")
        return df

    assert store_view(FileStore(spark, folder), build, "restless").first().paid == 33
    assert len(builds(spark, "restless")) == 1


def test_kpis_from_the_view_equal_those_from_the_joins(spark, sample):
    from cartsight.plans import queries

    assert kpi.kpi_summary(queries._facts(sample)).first() == kpi.kpi_summary(queries._categorised(sample)).first()
