from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from plans import final, physical
from pyspark.sql import functions as F

from cartsight.functions import (
    delay_category,
    delay_days,
    distance_band,
    haversine_km,
    rounded_delay,
    rounded_km,
)
from cartsight.operators import geo, kpi
from cartsight.operators.joins import join_facts, lookup_by_group
from cartsight.sources.schemas import COMMERCE


def _km(spark, *points):
    df = spark.createDataFrame(list(points), "a double, b double, c double, d double")
    km = haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return [r[0] for r in df.select(km).collect()]


def test_haversine(spark):
    rng = random.Random(1)
    pairs = [[rng.uniform(-90, 90), rng.uniform(-180, 180)] for _ in range(40)]
    forth = _km(spark, *[(*p, *q) for p, q in zip(pairs, pairs[1:])])
    back = _km(spark, *[(*q, *p) for p, q in zip(pairs, pairs[1:])])
    assert forth == pytest.approx(back, abs=1e-6)
    for km, (p, q) in zip(forth, zip(pairs, pairs[1:])):
        lat1, lng1, lat2, lng2 = (x * 0.0174533 for x in (*p, *q))
        cosine = math.sin(lat1) * math.sin(lat2) + math.cos(lat1) * math.cos(lat2) * math.cos(
            lng2 - lng1
        )
        assert km == pytest.approx(6371 * math.acos(max(-1, min(1, cosine))), abs=0.01)


def test_haversine_edges(spark):
    same, antipodal, poles = _km(
        spark, (12.5, -45.0, 12.5, -45.0), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0)
    )
    assert same == 0
    half_round = math.pi * 6371
    assert antipodal == pytest.approx(half_round, abs=1)
    assert poles == pytest.approx(half_round, abs=1)
    assert _km(spark, (None, 1.0, 2.0, 3.0), (1.0, float("nan"), 2.0, 3.0)) == [None, None]


def test_bands(spark):
    km = spark.createDataFrame([(v,) for v in [99.9, 100.0, 500.0, 500.1, None]], "v double")
    assert [r[0][0] for r in km.select(distance_band("v")).collect()] == list("12233")
    days = spark.createDataFrame([(v,) for v in [-5.1, -5.0, 0.0, 0.1, None]], "v double")
    kinds = [r[0].split(" ")[0] for r in days.select(delay_category("v")).collect()]
    assert kinds == ["Early", "On-Time", "On-Time", "Delayed", "Early"]


def test_delay_days_is_exact(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2020-01-01 01:12:00' a, timestamp_ntz'2020-01-01 00:00:00' b"
    )
    assert df.select(delay_days("a", "b"), delay_days("b", "a")).first() == (0.05, -0.05)
    assert df.select(rounded_delay("a", "b"), rounded_delay("b", "a")).first() == (0.1, -0.1)


def test_rounding_is_half_up_on_every_twentieth(spark):
    """All ties over three years, a second either side of them, and no negative zero."""
    seconds = F.explode(F.array(*[F.col("id") * 4320 + d for d in (-1, 0, 1)]))
    df = spark.range(-20_000, 20_000).select(seconds.alias("s"))
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    df = df.select("s", (start + F.make_dt_interval(secs=F.col("s"))).alias("t"), start.alias("u"))
    exact = (F.round(F.abs("s").cast("decimal(18,0)") / 86400, 1) * F.signum("s")).cast("double")
    rows = df.select(rounded_delay("t", "u").alias("mine"), (exact + 0.0).alias("exact"))
    assert rows.where("mine != exact").count() == 0
    assert rows.where("cast(mine AS string) = '-0.0'").count() == 0


def test_rounded_km(spark):
    rng = random.Random(8)
    points = [[rng.uniform(-89, 89), rng.uniform(-179, 179)] for _ in range(500)]
    rows = [(*p, *q) for p, q in zip(points, points[1:])] + [(None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    for mine, full in df.select(rounded_km(*ends), F.round(haversine_km(*ends), 1)).collect():
        assert mine == full


def test_centroid_keeps_pairs_together(spark):
    rows = [("1", 1.0, 2.0, "Zeta", "AA"), ("1", 2.0, 4.0, "Alpha", "BB")]
    rows += [("2", 5.5, 6.5, "Q", None)]
    found = geo.centroid_by_key(spark.createDataFrame(rows, COMMERCE["geolocation"]))
    assert {tuple(r) for r in found.collect()} == {
        ("1", 1.5, 3.0, "AA", "Zeta"),
        ("2", 5.5, 6.5, None, "Q"),
    }


def _shop(spark, lates):
    """One item per delay in minutes; customers in zip 1 or in zip 9, which has no position."""
    promised = dt.datetime(2021, 5, 1)
    arrived = [promised + dt.timedelta(minutes=m) for m in lates]
    orders = [
        (str(i), f"c{i}", "delivered", promised, None, None, at, promised)
        for i, at in enumerate(arrived)
    ]
    customers = [(f"c{i}", "9" if i == 0 else "1", "XX") for i in range(len(lates))]
    items = [(str(i), "p", "s1", 10.0, 2.5) for i in range(len(lates))]
    frame = spark.createDataFrame
    points = [("1", -20.0, -40.0, "A", "XX"), ("2", -21.0, -40.0, "B", "YY")]
    return (
        frame(items, COMMERCE["order_items"]),
        frame(orders, COMMERCE["orders"]),
        frame(customers, COMMERCE["customers"]),
        frame([("s1", "2", "YY")], COMMERCE["sellers"]),
        geo.centroid_by_key(frame(points, COMMERCE["geolocation"])),
    )


def test_shipments(spark):
    shipped = geo.with_delay_category(geo.shipments(*_shop(spark, [0, 20, 0, -20, 1440, -14400])))
    rows = {r["order_id"]: r for r in shipped.collect()}
    assert set(rows) == {"1", "2", "3", "4", "5"}
    assert [rows[i]["IsDelayed"] for i in "12345"] == [1, 0, 0, 1, 0]
    assert [rows[i]["DeliveryDelayDays"] for i in "12345"] == [0.0, 0.0, 0.0, 1.0, -10.0]
    assert rows["1"]["DelayCategory"].startswith("On-Time")
    assert rows["5"]["DelayCategory"].startswith("Early")
    assert rows["1"]["ShippingRoute"] == "XX -> YY"
    assert rows["1"]["DistanceKM"] == 111.2
    late = kpi.kpi_summary(shipped).first()
    assert tuple(late) == (0.4, 111.2, 2.5)
    assert kpi.kpi_summary(shipped, as_percent=True).first()[0] == 40.0
    assert tuple(kpi.delayed_rate(shipped).first()) == (40.0, 2.5)
    assert kpi.on_time_rate(shipped).first()[0] == 0.6
    assert [tuple(r) for r in geo.top_routes(shipped).collect()] == [("XX -> YY", 5)]


def test_kpis_of_nothing(spark):
    shipped = geo.shipments(*_shop(spark, [0, 1])).where("false")
    assert tuple(kpi.kpi_summary(shipped).first()) == (None, None, None)
    assert kpi.on_time_rate(shipped).first()[0] is None


def test_routes_are_null_when_a_state_is(spark):
    items, orders, customers, sellers, centroids = _shop(spark, [0, 0])
    sellers = sellers.withColumn("seller_state", F.lit(None).cast("string"))
    (row,) = geo.shipments(items, orders, customers, sellers, centroids).collect()
    assert row["ShippingRoute"] is None and row["DistanceKM"] == 111.2


def test_items_are_not_shuffled_by_zip(sample, settings, spark):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = physical(
        geo.shipments(
            sample.order_items,
            sample.orders,
            sample.customers,
            sample.sellers,
            geo.centroid_by_key(sample.geolocation),
        )
    )
    by_zip = [line for line in plan.splitlines() if "Exchange" in line and "zip" in line]
    assert by_zip and all("_slot" in line or "geolocation" in line for line in by_zip)
    assert "Broadcast" not in plan


def test_lookup_by_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice("abcd")) for i in range(900)] + [(901, None)]
    df = spark.createDataFrame(rows, "id long, g string")
    known = [("hot", 1), ("a", 2), ("a", 3), ("x", 4), (None, 5)]
    lookup = spark.createDataFrame(known, "g string, v int")
    found = sorted((r["id"], r["v"]) for r in lookup_by_group(df, lookup, "g", "id").collect())
    values = {"hot": [1], "a": [2, 3]}
    assert found == sorted((i, v) for i, g in rows for v in values.get(g, []))


@pytest.mark.parametrize("kind", ["facts", "lookup"])
def test_a_dominant_key_is_split(spark, settings, kind):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        spark__sql__shuffle__partitions="32",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
    rows = spark.range(0, 200_000, 1, 16).select("id", hot.alias("k"))
    if kind == "facts":
        joined = join_facts(rows, spark.range(1000).select(F.col("id").alias("k")), "k")
    else:
        rows = rows.select("id", F.when(F.col("k") == 7, 7).otherwise(8).alias("k"))
        means = rows.groupBy("k").agg(F.count("id").alias("n"))
        joined = lookup_by_group(rows, means, "k", "id", slots=2)
    counted = joined.groupBy((F.col("id") % 10).alias("d")).count()
    assert "SortMergeJoin(skew=true)" in final(counted)
    assert sum(r["count"] for r in counted.collect()) == 200_000
