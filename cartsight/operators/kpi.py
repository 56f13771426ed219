"""One-row summaries of the shipment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.functions import exact_mean, percent_of


def _delayed():
    return F.sum("IsDelayed")


def _rows():
    return F.count(F.lit(1))


def delayed_rate(shipped: DataFrame) -> DataFrame:
    """Percentage of delayed items (1 place) and mean freight."""
    return shipped.agg(
        F.round(percent_of(_delayed(), _rows()), 1).alias("DelayedPct"),
        F.round(exact_mean("freight_value"), 2).alias("AvgFreight"),
    )


def kpi_summary(shipped: DataFrame, as_percent: bool = False) -> DataFrame:
    """Delayed rate, mean distance and mean freight.

    The rate is a fraction to 4 places, or a percentage to 2 places with ``as_percent``.
    """
    if as_percent:
        rate = F.round(percent_of(_delayed(), _rows()), 2)
    else:
        rate = F.round(F.try_divide(_delayed(), _rows()), 4)
    return shipped.agg(
        rate.alias("DelayedRatePct"),
        F.round(exact_mean("DistanceKM"), 1).alias("AvgDistanceKM"),
        F.round(exact_mean("freight_value"), 2).alias("AvgFreightValue"),
    )


def on_time_rate(shipped: DataFrame) -> DataFrame:
    """Share of items that arrived on time or early, to 4 places."""
    return shipped.agg(
        F.round(F.try_divide(_rows() - _delayed(), _rows()), 4).alias("on_time_rate")
    )
