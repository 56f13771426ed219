"""Delivered against promised: delays of orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.functions import delay_days, delay_seconds, rounded_delay
from cartsight.functions.columns import SECONDS_PER_DAY
from cartsight.operators.quality import null_profile, row_count
from cartsight.operators.ranking import top_k, upper_median

LIFECYCLE = {
    "order_purchase_timestamp": "null_purchase",
    "order_approved_at": "null_approved",
    "order_delivered_carrier_date": "null_carrier",
    "order_delivered_customer_date": "null_customer",
    "order_estimated_delivery_date": "null_estimated",
}
ARRIVED = "order_delivered_customer_date"
PROMISED = "order_estimated_delivery_date"


def delivered(orders: DataFrame) -> DataFrame:
    """Orders that have arrived and carry a delivery date."""
    return orders.where((F.col("order_status") == "delivered") & F.col(ARRIVED).isNotNull())


def lifecycle_gaps(orders: DataFrame) -> DataFrame:
    """Missing dates along the life of an order."""
    return null_profile(orders, LIFECYCLE, total_name="total_orders")


def missing_delivery_by_status(orders: DataFrame) -> DataFrame:
    """Orders and missing delivery dates per status, largest status first."""
    profile = null_profile(
        orders, {ARRIVED: "missing_delivery_date"}, by="order_status", total_name="total_orders"
    )
    return profile.orderBy(F.desc("total_orders"), "order_status")


def delivered_without_date(orders: DataFrame) -> DataFrame:
    """Orders marked delivered although nobody noted when."""
    return orders.where((F.col("order_status") == "delivered") & F.col(ARRIVED).isNull()).select(
        "order_id", "order_status", "order_purchase_timestamp", ARRIVED
    )


def worst_delays(orders: DataFrame, k: int = 10) -> DataFrame:
    delay = rounded_delay(ARRIVED, PROMISED).alias("DeliveryDelayDays")
    rows = delivered(orders).select("order_id", ARRIVED, PROMISED, delay)
    return top_k(rows, "DeliveryDelayDays", k, tiebreak="order_id")


def busiest_delivery_days(orders: DataFrame, k: int = 5) -> DataFrame:
    per_day = (
        delivered(orders)
        .groupBy(F.to_date(ARRIVED).alias("DeliveryDate"))
        .agg(F.count(F.lit(1)).alias("NumberOfOrders"))
    )
    return top_k(per_day, "NumberOfOrders", k, tiebreak="DeliveryDate")


def severe_delays_on_day(orders: DataFrame, day: dt.date, above_days: float = 100) -> DataFrame:
    """How many orders arrived on ``day`` more than ``above_days`` late.

    The day is a range on the timestamp itself, which the file scan can use to skip row groups.
    """
    midnight = dt.datetime.combine(day, dt.time())
    arrived = F.col(ARRIVED)
    on_day = (arrived >= _ntz(midnight)) & (arrived < _ntz(midnight + dt.timedelta(days=1)))
    late = delivered(orders).where(on_day & (delay_days(ARRIVED, PROMISED) > above_days))
    return row_count(late, "severe_delays")


def _ntz(moment: dt.datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def delay_stats(orders: DataFrame) -> DataFrame:
    """Mean, earliest and latest delivery against the promise, in days."""
    delay = delay_days(ARRIVED, PROMISED)
    seconds = delay_seconds(ARRIVED, PROMISED)
    mean = F.try_divide(F.sum(seconds).cast("double"), F.count(seconds))
    return delivered(orders).agg(
        F.round(mean / SECONDS_PER_DAY, 2).alias("AvgDelayDays"),
        F.round(F.min(delay), 1).alias("BestCase_EarlyDays"),
        F.round(F.max(delay), 1).alias("WorstCase_DelayDays"),
    )


def median_delay(orders: DataFrame) -> DataFrame:
    """Upper median of the delay, after rounding to a tenth of a day."""
    delay = rounded_delay(ARRIVED, PROMISED).alias("delay")
    return upper_median(delivered(orders).select(delay), "delay", "MedianDelayDays")
