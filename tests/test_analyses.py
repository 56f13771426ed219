"""Every named analysis against its SQL statement on the sample tables."""

from __future__ import annotations

import datetime as dt

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import SAMPLE
from plans import physical
from pyspark.sql import types as T

import __spark_entry__
from cartsight.plans import ORACLES, QUERIES

_KINDS = {
    T.LongType: int,
    T.IntegerType: int,
    T.DoubleType: float,
    T.StringType: str,
    T.DateType: dt.date,
    T.TimestampNTZType: dt.datetime,
}


@pytest.fixture(scope="module")
def con():
    return connect(SAMPLE)


def test_every_analysis_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SAMPLE)
    assert "BroadcastNestedLoopJoin" not in physical(df)
    assert "CartesianProduct" not in physical(df)
    names, rows = spark_rows(df)
    expected_names, expected = duck_rows(con, ORACLES[name])
    assert names == expected_names
    assert rows == expected
    for field in df.schema:
        values = [row[names.index(field.name)] for row in expected]
        kinds = {type(v) for v in values if v is not None}
        assert kinds <= {_KINDS[type(field.dataType)]}, field


@pytest.mark.parametrize(
    "name",
    ["o15_top_categories", "o17_above_category_average", "o19_top3_per_category"]
    + ["g06_order_distance", "d03_map_points", "f06_accuracy", "f04t_forecast_total"],
)
def test_same_rows_without_any_broadcast(spark, con, settings, name):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    df = QUERIES[name](spark, SAMPLE)
    plan = physical(df)
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    assert spark_rows(df) == duck_rows(con, ORACLES[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [r["DistanceGroup"][0] for r in rows] == ["1", "2", "3"]


def test_known_results(spark):
    """Results worked out beforehand on the same sample."""

    def only(name):
        return tuple(QUERIES[name](spark, SAMPLE).first())

    assert only("o02b_orders_without_items") == (257,)
    assert only("o05_customer_totals") == (1500, 1500)
    assert only("o06_null_profile") == (15000, 0, 25, 255, 5096, 0)
    assert only("o12_delay_stats") == (-9.74, -26.0, 152.0)
    assert only("o13_median_delay") == (-9.9,)
    assert only("g13_kpi_fraction") == (0.1028, 676.4, 25.42)
    assert only("d04_on_time_rate") == (0.8972,)
    assert only("d07_price_gap") == (1.0016,)
    bands = QUERIES["g08_delay_by_distance_band"](spark, SAMPLE).collect()
    assert [r["NumberOfOrders"] for r in bands] == [1843, 11531, 24632]


def test_bands_cover_all_shipments(spark):
    bands = QUERIES["g08_delay_by_distance_band"](spark, SAMPLE).collect()
    shipped = QUERIES["d02_freight_vs_distance"](spark, SAMPLE).count()
    assert sum(r["NumberOfOrders"] for r in bands) == shipped == 38006


def test_late_flag_and_category_differ_near_zero(spark):
    shipped = QUERIES["g11_delay_category"](spark, SAMPLE)
    both = shipped.where("IsDelayed = 1 and DelayCategory like 'On-Time%'")
    assert both.count() == 34
