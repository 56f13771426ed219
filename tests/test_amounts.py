"""Money is added up as it is, whatever its decimals; what is no number counts as missing."""

from __future__ import annotations

import random
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartsight.functions import amount, exact_mean, exact_sum, joined_limbs, limbs
from cartsight.operators import catalog, forecast, payments
from cartsight.sources import FileStore, read_monthly

NAN = float("nan")


def test_small_amounts_are_not_cut(spark):
    paid = spark.range(1000).select(
        F.col("id").alias("order_id"), F.lit("card").alias("payment_type"), F.lit(0.004).alias("payment_value")
    )
    row = payments.payment_summary(paid).first().asDict()
    assert row["total_payment_value"] == 4.0


def test_no_number_is_no_payment(spark):
    paid = spark.createDataFrame([(1, "card", NAN), (2, "card", 2.5), (3, "card", None)], "order_id long, payment_type string, payment_value double")
    row = payments.payment_summary(paid).first().asDict()
    assert row["total_payment_value"] == 2.5 and row["avg_payment_value"] == 2.5


@pytest.mark.parametrize("prices", [(10.004, 10.0, 9.999), (1.001, 1.002, 1.003), (0.1, 0.1, 0.1)])
def test_above_the_mean_of_three_decimals(spark, prices):
    items = spark.createDataFrame([(i, 1, p) for i, p in enumerate(prices)], "order_id long, product_id long, price double")
    products = spark.createDataFrame([(1, "a")], "product_id long, product_category_name string")
    found = sorted(r.price for r in catalog.above_category_average(items, products).collect())
    assert found == sorted({10.004: [10.004], 1.001: [1.003], 0.1: []}[prices[0]])
    share = catalog.above_average_share(items, products).first()[0]
    assert share == round(len(found) / 3, 4)


def test_cheap_and_unpriced_categories_do_not_widen_the_top(spark):
    rows = [(i, i % 50, float(i)) for i in range(500)] + [(900, 100, 0.01), (901, 101, None), (902, 102, 5.0), (903, 102, 5.0)]
    items = spark.createDataFrame(rows, "order_id long, product_id long, price double")
    products = spark.createDataFrame(
        [(i, "wide") for i in range(50)] + [(100, "cheap"), (101, "none"), (102, "twice"), (103, None)],
        "product_id long, product_category_name string",
    )
    top = catalog.top_prices_per_category(items, products, chunk=1)
    found = sorted((r.category, r.price, r.RankInCategory) for r in top.collect() if r.price is not None)
    assert found == [
        ("cheap", 0.01, 1), ("twice", 5.0, 1), ("twice", 5.0, 1), ("wide", 497.0, 3), ("wide", 498.0, 2), ("wide", 499.0, 1),
    ]
    assert top.where("category = 'none'").count() == 1


def test_a_missing_month_is_no_point(spark):
    series = spark.createDataFrame([("2020-01", 1.0), ("2020-02", 2.0), (None, 9.0)], "m string, y double")
    ready = forecast.to_series(series, "m", "y")
    assert forecast.fit_trend(ready).first()["n"] == 2
    assert forecast.extend_months(series.select(F.to_date("m", "yyyy-MM").alias("ds"), "y")).where("ds IS NULL").count() == 0


def test_csv_that_does_not_fit_is_an_error(spark, tmp_path):
    folder = tmp_path / "payments.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("order_id,payment_type,payment_value\n1,card,2.5\n")
    (folder / "b.csv").write_text("payment_type,order_id,payment_value\ncard,2,3.5\n")
    with pytest.raises(Exception, match=r"(?i)header|malformed|schema"):
        FileStore(spark, str(tmp_path), "csv").payments.collect()
    bad = tmp_path / "monthly.csv"
    bad.write_text("OrderMonth,MonthlyRevenue\r\n2020-01,12;50\r\n")
    with pytest.raises(Exception, match=r"(?i)malformed"):
        read_monthly(spark, str(bad)).collect()
    bad.write_text("OrderMonth,MonthlyRevenue\r\n2020-01,12.5\r\n")
    assert read_monthly(spark, str(bad)).first()["MonthlyRevenue"] == 12.5


def test_not_in_with_missing_keys_and_orphans(spark):
    from cartsight.operators import quality

    child = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (3,)], "k long")
    for unique in (True, False):
        assert quality.orphan_count(child, parent, "k", parent_unique=unique).first()[0] == 2


def test_everything_builds_without_a_checkpoint_folder(tmp_path):
    """In a session of its own that sets no folder at all."""
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
assert __spark_entry__.entry(spark).count() == 3
for name in ("g05_order_coordinates", "g08_delay_by_distance_band", "g11_delay_category", "f06t_accuracy_total"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    root = str(Path(__file__).resolve().parent.parent)
    import os

    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code, root, str(tmp_path / "warehouse")], capture_output=True, text=True, timeout=240, env=env)
    assert done.returncode == 0, done.stderr[-2000:]


def test_limbs_are_the_amount(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(-1, 1) * 10 ** rng.randint(0, 11), rng.randint(0, 3)) for _ in range(5000)]
    values += [0.1, 0.004, -0.004, 1.005, 99999.99, -123456789.12, 999999999999999.0, 1e17, 1e18, -1e18, NAN, float("inf")]
    values += [None, -0.0, 0.00000000005, 123456.123456789, 0.99999999999, 2.0**52, 123456789012.345]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", amount("v").alias("a"), joined_limbs(limbs("v")).alias("l")).collect():
        assert row.a == row.l, row.v


@pytest.mark.parametrize("kind", ["decimal(28,10)", "decimal(20,4)", "int", "bigint", "float", "string"])
def test_limbs_of_other_types(spark, kind):
    df = spark.createDataFrame([("12.25",), ("-7",), ("0.0625",), (None,), ("99999.5",)], "v string").select(F.col("v").cast("double").cast(kind).alias("v"))
    for row in df.select("v", amount("v").alias("a"), joined_limbs(limbs("v")).alias("l")).collect():
        assert row.a == row.l, row.v


def test_sums_and_means_are_the_same_in_any_order(spark):
    rng = random.Random(4)
    values = [round(rng.uniform(-1e6, 1e6), 3) for _ in range(3000)] + [1e12, -1e12, 0.0000000001]
    exact = sum(Decimal(repr(v)) for v in values)
    found = set()
    for seed in range(20):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(1 + seed % 8)
        found.add(tuple(df.agg(exact_sum("v"), exact_mean("v")).first()))
    assert found == {(exact, float(exact) / len(values))}


def test_positions_have_the_same_mean_in_any_order(spark):
    from cartsight.operators import geo

    rng = random.Random(5)
    rows = [("z", round(rng.uniform(-34, 5), 12), round(rng.uniform(-73, -34), 12), "s", "c") for _ in range(2000)]
    names = "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, geolocation_state string, geolocation_city string"
    found = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        found.add(tuple(geo.centroid_by_key(spark.createDataFrame(rows, names).repartition(7)).first()))
    assert len(found) == 1


def test_very_many_large_amounts_do_not_overflow(spark):
    df = spark.range(3_000_000).select(F.lit(9.99e17).alias("v"))
    assert df.agg(exact_sum("v")).first()[0] == Decimal(999 * 10**15) * 3_000_000
