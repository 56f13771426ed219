"""Delivery, payments and catalogue on hand-made rows."""

from __future__ import annotations

import datetime as dt
import random
from fractions import Fraction

import pytest

from cartsight.operators import catalog, delivery, payments
from cartsight.sources.schemas import COMMERCE

PROMISED = dt.datetime(2020, 3, 10)


def _orders(spark, rows):
    """(id, status, days after the promise or None) with a fixed promise."""
    full = [
        (
            str(i),
            "c",
            status,
            PROMISED - dt.timedelta(days=20),
            None,
            None,
            None if late is None else PROMISED + dt.timedelta(days=late),
            PROMISED,
        )
        for i, status, late in rows
    ]
    return spark.createDataFrame(full, COMMERCE["orders"])


def test_delay_is_fractional_and_signed(spark):
    orders = _orders(spark, [(1, "delivered", -1.5), (2, "delivered", 0.25), (3, "shipped", 9)])
    assert tuple(delivery.delay_stats(orders).first()) == (-0.63, -1.5, 0.3)
    worst = delivery.worst_delays(orders, 5).collect()
    assert [(r["order_id"], r["DeliveryDelayDays"]) for r in worst] == [("2", 0.3), ("1", -1.5)]


def test_severe_delays_on_one_day(spark):
    rows = [(i, "delivered", 120 + i / 100) for i in range(3)]
    rows += [(10, "delivered", 119.9), (11, "delivered", 121.0), (12, "returned", 120.5)]
    day = (PROMISED + dt.timedelta(days=120)).date()
    orders = _orders(spark, rows)
    assert delivery.severe_delays_on_day(orders, day).first()[0] == 3
    assert delivery.severe_delays_on_day(orders, day, above_days=120.015).first()[0] == 1
    assert delivery.severe_delays_on_day(orders, dt.date(2001, 1, 1)).first()[0] == 0


def test_day_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders.parquet")
    _orders(spark, [(1, "delivered", 1)]).write.parquet(path)
    stored = spark.read.schema(COMMERCE["orders"]).parquet(path)
    found = delivery.severe_delays_on_day(stored, dt.date(2020, 3, 11))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(order_status,delivered)" in pushed
    assert "GreaterThanOrEqual(order_delivered_customer_date" in pushed


def test_missing_dates(spark):
    rows = [(1, "delivered", None), (2, "delivered", 1), (3, "canceled", None)]
    orders = _orders(spark, [*rows, (4, "delivered", 0)])
    by_status = [tuple(r) for r in delivery.missing_delivery_by_status(orders).collect()]
    assert by_status == [("delivered", 3, 1), ("canceled", 1, 1)]
    assert [r["order_id"] for r in delivery.delivered_without_date(orders).collect()] == ["1"]
    assert tuple(delivery.lifecycle_gaps(orders).first()) == (4, 0, 4, 4, 2, 0)


def test_busiest_days_and_median(spark):
    lates = [0.1, 0.2, 1.5, -3.3, -3.4, -3.5]
    orders = _orders(spark, [(i, "delivered", d) for i, d in enumerate(lates)])
    days = [tuple(r) for r in delivery.busiest_delivery_days(orders, 2).collect()]
    assert days == [(dt.date(2020, 3, 6), 3), (dt.date(2020, 3, 10), 2)]
    assert delivery.median_delay(orders).first()[0] == 0.1


def test_payment_summary(spark):
    rows = [("1", "card", 10.10), ("1", "card", 0.05), ("2", "slip", 3.0), ("3", "none", None)]
    df = spark.createDataFrame(rows, COMMERCE["payments"])
    found = [tuple(r) for r in payments.payment_summary(df).collect()]
    assert found == [("card", 2, 5.08, 10.15), ("none", 1, None, None), ("slip", 1, 3.0, 3.0)]
    shares = {r["payment_type"]: r["share"] for r in payments.payment_share(df).collect()}
    assert shares == {"card": 0.5, "slip": 0.25, "none": 0.25}


@pytest.fixture
def shop(spark):
    items = spark.createDataFrame(
        [("1", "p1", "s", 10.0, 0.0), ("1", "p1", "s", 20.0, 0.0), ("2", "p2", "s", 30.0, 0.0)]
        + [("3", "p3", "s", 5.0, 0.0), ("4", "p4", "s", 99.0, 0.0), ("5", "p5", "s", 7.0, 0.0)],
        COMMERCE["order_items"],
    )
    products = spark.createDataFrame(
        [("p1", "um"), ("p2", "um"), ("p3", "dois"), ("p4", None), ("p5", "sem")],
        COMMERCE["products"],
    )
    names = spark.createDataFrame([("um", "one"), ("dois", "two")], COMMERCE["translation"])
    return items, products, names


def test_category_revenue_drops_unnamed(shop):
    found = [tuple(r) for r in catalog.revenue_by_category(*shop).collect()]
    assert found == [("one", 3, 60.0), ("two", 1, 5.0)]
    prices = {tuple(r) for r in catalog.category_average_price(*shop, ["one", "two"]).collect()}
    assert prices == {("one", 20.0), ("two", 5.0)}
    assert catalog.category_price_gap(*shop, "one", "two").first()[0] == 4.0
    assert catalog.category_price_gap(*shop, "one", "three").first()[0] is None


def test_above_average(shop):
    items, products, _ = shop
    found = [tuple(r) for r in catalog.above_category_average(items, products).collect()]
    assert found == [("2", "um", 30.0)]
    assert catalog.above_average_share(items, products).first()[0] == round(1 / 6, 4)


@pytest.mark.parametrize("seed", range(3))
def test_above_average_is_exact(spark, seed):
    """Equal prices, refunds and a category of one price, against exact fractions."""
    rng = random.Random(seed)
    cents = {
        "same": [1999] * 60,
        "mixed": [rng.randrange(-300, 300) for _ in range(90)],
        "close": [333, 333, 334],
        "negative": [-5, -5, -4],
    }
    category_of, rows = {}, []
    for category, prices in cents.items():
        for price in prices:
            product = f"{category}{rng.randrange(4)}"
            category_of[product] = category
            rows.append((str(len(rows)), product, "s", price / 100, 0.0))
    expected = sorted(
        (row[0], category_of[row[1]], row[3])
        for row in rows
        if Fraction(round(row[3] * 100))
        > Fraction(sum(cents[category_of[row[1]]]), len(cents[category_of[row[1]]]))
    )
    items = spark.createDataFrame(rows, COMMERCE["order_items"])
    products = spark.createDataFrame(list(category_of.items()), COMMERCE["products"])
    found = catalog.above_category_average(items, products).collect()
    assert sorted(tuple(r) for r in found) == expected
