"""Where customers and sellers are, how far apart, and what that does to delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.functions import (
    delay_category,
    distance_band,
    exact_mean,
    percent_of,
    rounded_delay,
    rounded_km,
    tile_key,
)
from cartsight.functions.columns import DELAYED, ROUTE_ARROW
from cartsight.operators.delivery import ARRIVED, PROMISED, delivered
from cartsight.operators.joins import join_facts, lookup_by_group
from cartsight.operators.ranking import top_k

ZIP = "geolocation_zip_code_prefix"


def zip_repetition(geolocation: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` zip prefixes with the most points."""
    points = geolocation.groupBy(ZIP).agg(F.count(F.lit(1)).alias("RepeatCount"))
    return top_k(points, "RepeatCount", k, tiebreak=ZIP)


def centroid_by_key(
    points: DataFrame,
    key: str = ZIP,
    lat: str = "geolocation_lat",
    lng: str = "geolocation_lng",
    place: Sequence[str] = ("geolocation_state", "geolocation_city"),
) -> DataFrame:
    """One row per key: mean position to 6 places, and one of its (state, city) pairs.

    A zip may list several cities. The smallest pair is taken, so that city and state belong
    together and the choice is the same in every run.
    """
    means = [
        F.round(exact_mean(lat), 6).alias("avg_lat"),
        F.round(exact_mean(lng), 6).alias("avg_lng"),
    ]
    grouped = points.groupBy(key).agg(*means, F.min(F.struct(*place)).alias("place"))
    return grouped.select(key, "avg_lat", "avg_lng", *[f"place.{c}" for c in place])


def _positions(centroids: DataFrame, role: str) -> DataFrame:
    return centroids.select(
        F.col(ZIP).alias(f"{role}_zip_code_prefix"),
        F.col("avg_lat").alias(f"{role}_lat"),
        F.col("avg_lng").alias(f"{role}_lng"),
    )


def _located(people: DataFrame, centroids: DataFrame, role: str) -> DataFrame:
    zip_column = f"{role}_zip_code_prefix"
    return lookup_by_group(people, _positions(centroids, role), zip_column, f"{role}_id")


def order_geo(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    centroids: DataFrame,
) -> DataFrame:
    """Order items with the positions of their customer and seller; unplaced ones drop out.

    Positions join the customers and sellers, not the items, so the large table is never shuffled
    by zip. Items meet the orders first: when they reach the sellers, Spark has measured that side
    and takes a broadcast only if it is small; none is asked for by a hint. Pass ``centroids`` from
    a stored table: they are used twice, and their file size tells Spark whether to broadcast them.
    """
    buyers = _located(customers, centroids, "customer")
    shops = _located(sellers, centroids, "seller")
    sold = join_facts(items, join_facts(orders, buyers, "customer_id"), "order_id")
    return sold.join(shops, "seller_id")


def dropped_items(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    centroids: DataFrame,
) -> DataFrame:
    """One row: how many items there are, how many :func:`order_geo` places, and how many drop out.

    Where a key of the other tables repeats, items multiply and ``dropped_items`` may be negative.
    """
    placed = order_geo(items, orders, customers, sellers, centroids)
    rows = F.count(F.lit(1))
    total = items.agg(rows).scalar()
    return placed.agg(
        total.alias("items"),
        rows.alias("placed_items"),
        (total - rows).alias("dropped_items"),
    )


def _distance():
    ends = ["customer_lat", "customer_lng", "seller_lat", "seller_lng"]
    return rounded_km(*[F.col(c) for c in ends]).alias("DistanceKM")


def order_coordinates(placed: DataFrame) -> DataFrame:
    """From :func:`order_geo`: zip and position of both ends."""
    return placed.select(
        "order_id",
        "customer_zip_code_prefix",
        "customer_lat",
        "customer_lng",
        "seller_zip_code_prefix",
        "seller_lat",
        "seller_lng",
    )


def order_distance(placed: DataFrame) -> DataFrame:
    """From :func:`order_geo`: both positions and the distance between them."""
    return placed.select(
        "order_id", "customer_lat", "customer_lng", "seller_lat", "seller_lng", _distance()
    )


# Columns of the successive versions of the shipment table.
VERSION_1 = ["order_id", "DistanceKM", "DeliveryDelayDays"]
VERSION_2 = [
    "order_id",
    "price",
    "freight_value",
    "customer_state",
    "seller_state",
    "ShippingRoute",
    "DistanceKM",
    "DeliveryDelayDays",
    "IsDelayed",
]
VERSION_3 = [*VERSION_2, "customer_zip_code_prefix"]


def shipments(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    centroids: DataFrame,
) -> DataFrame:
    """Delivered items with route, distance, delay and the late flag.

    The earlier versions of this table are selections of its columns. ``IsDelayed`` looks at the
    exact delay: an item 20 minutes late is delayed although its rounded delay is 0.
    """
    placed = order_geo(items, delivered(orders), customers, sellers, centroids)
    route = F.concat("customer_state", F.lit(ROUTE_ARROW), "seller_state")
    return placed.select(
        "order_id",
        "price",
        "freight_value",
        "customer_zip_code_prefix",
        "customer_state",
        "seller_state",
        route.alias("ShippingRoute"),
        _distance(),
        rounded_delay(ARRIVED, PROMISED).alias("DeliveryDelayDays"),
        F.when(F.col(ARRIVED) > F.col(PROMISED), 1).otherwise(0).alias("IsDelayed"),
    )


def with_delay_category(shipped: DataFrame) -> DataFrame:
    """Add the three-way category of the rounded delay."""
    return shipped.withColumn("DelayCategory", delay_category("DeliveryDelayDays"))


def delay_by_distance_band(shipped: DataFrame) -> DataFrame:
    """Items and mean delay for near, medium and far shipments."""
    return (
        shipped.groupBy(distance_band("DistanceKM").alias("DistanceGroup"))
        .agg(
            F.count(F.lit(1)).alias("NumberOfOrders"),
            F.round(exact_mean("DeliveryDelayDays"), 1).alias("AvgDelayDays"),
        )
        .orderBy("DistanceGroup")
    )


def top_routes(shipped: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` busiest routes between states."""
    routes = shipped.groupBy("ShippingRoute").agg(F.count(F.lit(1)).alias("NumberOfOrders"))
    return top_k(routes, "NumberOfOrders", k, tiebreak="ShippingRoute")


def freight_vs_distance(categorised: DataFrame) -> DataFrame:
    """Freight, distance and delay category per item."""
    return categorised.select("freight_value", "DistanceKM", "DelayCategory")


def map_points(categorised: DataFrame, centroids: DataFrame) -> DataFrame:
    """Items per location and delay category. Items are counted before the positions join."""
    per_zip = categorised.groupBy("customer_zip_code_prefix", "DelayCategory").agg(
        F.count(F.lit(1)).alias("NumberOfOrders")
    )
    return per_zip.join(_positions(centroids, "customer"), "customer_zip_code_prefix").select(
        "customer_zip_code_prefix",
        "customer_lat",
        "customer_lng",
        "DelayCategory",
        "NumberOfOrders",
    )


def map_tiles(points: DataFrame, zoom: int = 12) -> DataFrame:
    """From :func:`map_points`: items and late items of every tile that has any, at each zoom level.

    (zoom, tile, NumberOfOrders, Delayed, DelayedPct). Items are added up to the tiles of the finest
    level first; all levels follow from these in one more grouping, as a tile holds four of the next.
    Items without a position are in no tile.
    """
    late = F.when(F.col("DelayCategory") == DELAYED, F.col("NumberOfOrders")).otherwise(0)
    finest = (
        points.select(tile_key("customer_lat", "customer_lng", zoom).alias("key"), "NumberOfOrders", late.alias("Delayed"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.sum("NumberOfOrders").alias("NumberOfOrders"), F.sum("Delayed").alias("Delayed"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("zoom")
    tile = F.call_function("shiftright", F.col("key"), (zoom - F.col("zoom")) * 2)
    return (
        finest.select("*", levels)
        .groupBy("zoom", tile.alias("tile"))
        .agg(F.sum("NumberOfOrders").alias("NumberOfOrders"), F.sum("Delayed").alias("Delayed"))
        .withColumn("DelayedPct", F.round(percent_of(F.col("Delayed"), F.col("NumberOfOrders")), 2))
    )
