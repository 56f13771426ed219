"""Published results, for whoever has the published data set.

Set CARTSIGHT_SHOP to a folder with the commerce tables as CSV files named as in
``cartsight/sources/schemas.py``. Without it these tests are skipped.
"""

from __future__ import annotations

import datetime as dt
import os

import pytest
from test_forecast import REVENUE

from cartsight.operators import catalog, delivery, forecast, geo, kpi, payments, quality
from cartsight.sources import FileStore, store_and_read

FOLDER = os.environ.get("CARTSIGHT_SHOP")
pytestmark = pytest.mark.skipif(not FOLDER, reason="CARTSIGHT_SHOP is not set")


@pytest.fixture(scope="module")
def shop(spark):
    return FileStore(spark, FOLDER, "csv")


@pytest.fixture(scope="module")
def zips(shop):
    return store_and_read(geo.centroid_by_key(shop.geolocation), "geolocation_summary")


@pytest.fixture(scope="module")
def shipped(shop, zips):
    frame = geo.shipments(shop.order_items, shop.orders, shop.customers, shop.sellers, zips)
    return store_and_read(geo.with_delay_category(frame), "order_distance_delay")


def test_quality(shop):
    s = shop
    assert quality.duplicate_keys(s.orders, "order_id").count() == 0
    for child, parent, key in [
        (s.order_items, s.orders, "order_id"),
        (s.orders, s.customers, "customer_id"),
        (s.customers, s.orders, "customer_id"),
        (s.order_items, s.products, "product_id"),
        (s.products, s.order_items, "product_id"),
    ]:
        assert quality.orphan_count(child, parent, key).first()[0] == 0
    assert tuple(quality.compare_counts(s.customers, s.orders, "customer_id").first()) == (
        99441,
        99441,
    )
    assert tuple(delivery.lifecycle_gaps(s.orders).first()) == (99441, 0, 160, 1783, 2965, 0)
    assert tuple(delivery.missing_delivery_by_status(s.orders).first()) == ("delivered", 96478, 8)
    assert delivery.delivered_without_date(s.orders).count() == 8
    assert quality.missing_count(s.products, catalog.CATEGORY).first()[0] == 610


def test_delivery(shop):
    worst = delivery.worst_delays(shop.orders).collect()
    lates = [round(r["DeliveryDelayDays"]) for r in worst]
    assert 159 <= lates[-1] <= lates[0] <= 189
    day = dt.date(2017, 9, 19)
    assert sum(r[delivery.ARRIVED].date() == day for r in worst) == 6
    busiest = delivery.busiest_delivery_days(shop.orders).collect()
    assert [busiest[0]["NumberOfOrders"], busiest[-1]["NumberOfOrders"]] == [446, 425]
    assert {r["DeliveryDate"].year for r in busiest} == {2018}
    assert delivery.severe_delays_on_day(shop.orders, day).first()[0] == 21
    stats = tuple(delivery.delay_stats(shop.orders).first())
    assert stats == pytest.approx((-11.18, -146.0, 189.0), abs=0.1)
    assert delivery.median_delay(shop.orders).first()[0] == pytest.approx(-11.9, abs=0.1)


def test_payments_and_catalogue(shop):
    paid = {r[0]: tuple(r)[1:] for r in payments.payment_summary(shop.payments).collect()}
    assert paid["credit_card"][:2] == (76795, 163.32)
    assert paid["not_defined"] == (3, 0.0, 0.0)
    items, products, names = shop.order_items, shop.products, shop.translation
    first, second = catalog.revenue_by_category(items, products, names).take(2)
    assert (first[0], first[1], int(first[2])) == ("health_beauty", 9670, 1258681)
    assert (second[0], second[1], int(second[2])) == ("watches_gifts", 5991, 1205005)
    pair = ["health_beauty", "watches_gifts"]
    means = catalog.category_average_price(items, products, names, pair).collect()
    assert {r[0]: r[1] for r in means} == {"health_beauty": 130.16, "watches_gifts": 201.14}
    assert catalog.above_category_average(items, products).count() == 36178
    top = catalog.top_prices_per_category(items, products).where("RankInCategory = 1")
    highest = {r["category"]: r["price"] for r in top.collect()}
    assert highest["agro_industria_e_comercio"] == 2990
    assert highest["alimentos"] == 274.99


def test_geo(shop, zips, shipped):
    assert quality.row_count(shop.geolocation).first()[0] == 1000163
    assert tuple(geo.zip_repetition(shop.geolocation).first()) == ("24220", 1146)
    assert zips.count() == 19015
    assert shipped.count() == 109653
    assert shipped.selectExpr("round(avg(DistanceKM), 1)").first()[0] == 596.3
    bands = [r["AvgDelayDays"] for r in geo.delay_by_distance_band(shipped).collect()]
    assert bands == pytest.approx([-8.9, -11.6, -12.2], abs=0.1)
    assert tuple(kpi.delayed_rate(shipped).first()) == (7.9, 19.94)
    assert round(kpi.kpi_summary(shipped).first()[0], 3) == 0.079


def test_monthly_revenue(shop):
    series = forecast.monthly_revenue(shop.order_items, shop.orders)
    months = series.where("ds between date'2017-01-01' and date'2018-08-01'").orderBy("ds")
    assert [r["y"] for r in months.collect()] == pytest.approx(REVENUE)
