"""The named analyses, each a function of (spark, folder of the sample tables)."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.functions import delay_category, delay_seconds, exact_sum
from cartsight.operators import (
    catalog,
    delivery,
    forecast,
    geo,
    kpi,
    outlook,
    payments,
    quality,
    ranking,
)
from cartsight.sources import (
    SampleStore,
    add_column,
    import_csv,
    materialise,
    new_table_name,
    publish,
    read_monthly,
    store_and_read,
    store_partitioned,
    store_view,
    update,
    write_folder,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES = ["product_category_name", "customer_state"]
SEVERE_DAY = dt.date(1995, 6, 29)
DEAR, CHEAP = "large", "economy"
WAVES = 2
CHANGES = 4
DRAWS = 100
ZOOM = 12


def query(name: str) -> Callable[[Callable[[SampleStore], DataFrame]], Query]:
    """Register a function of the store under ``name``."""

    def register(build: Callable[[SampleStore], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(SampleStore(spark, sf_dir))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        return run

    return register


# --- data quality ------------------------------------------------------------------------------


@query("o01_duplicate_orders")
def _(s):
    """Order ids that occur more than once."""
    return quality.duplicate_keys(s.orders, "order_id")


@query("o01b_orders_above_ten_items")
def _(s):
    """The same grouping on the items: orders with more than ten of them."""
    return quality.duplicate_keys(s.order_items, "order_id", above=10)


@query("o02_orphan_items")
def _(s):
    return quality.orphan_count(s.order_items, s.orders, "order_id", parent_unique=True)


@query("o02b_orders_without_items")
def _(s):
    return quality.orphan_count(s.orders, s.order_items, "order_id")


@query("o03a_orders_without_customer")
def _(s):
    return quality.orphan_count(s.orders, s.customers, "customer_id", parent_unique=True)


@query("o03b_customers_without_orders")
def _(s):
    return quality.orphan_count(s.customers, s.orders, "customer_id")


@query("o04a_items_without_product")
def _(s):
    return quality.orphan_count(s.order_items, s.products, "product_id", parent_unique=True)


@query("o04b_products_never_sold")
def _(s):
    return quality.orphan_count(s.products, s.order_items, "product_id")


REFERENCES = {
    "items without order": quality.Reference("items", "order_id", "orders", "order_id"),
    "orders without items": quality.Reference("orders", "order_id", "items", "order_id"),
    "orders without customer": quality.Reference("orders", "customer_id", "customers", "customer_id"),
    "customers without orders": quality.Reference("customers", "customer_id", "orders", "customer_id"),
    "items without product": quality.Reference("items", "product_id", "products", "product_id"),
    "products never sold": quality.Reference("products", "product_id", "items", "product_id"),
    "items whose order is missing": quality.Reference("items", "order_id", "some orders", "order_id"),
}


@query("o04r_reference_report")
def _(s):
    """All reference checks at once, and one more against orders of which a fifth is missing."""
    tables = {"items": s.order_items, "orders": s.orders, "customers": s.customers, "products": s.products}
    return quality.reference_report({**tables, "some orders": _gappy_orders(s)}, REFERENCES)


def _gappy_orders(s: SampleStore) -> DataFrame:
    """Orders of which a fifth is missing, so that items and customers lose theirs."""
    return s.orders.where(F.col("order_id") % 5 != 0)


def _gappy_items(s: SampleStore) -> DataFrame:
    """Items of which some do not say to which order they belong."""
    return s.order_items.withColumn(
        "order_id", F.when(F.col("order_id") % 11 != 0, F.col("order_id"))
    )


def _orphans_in_gaps(s: SampleStore, parent_unique: bool) -> DataFrame:
    """Orphans where keys are NULL or missing: one row for each rule of ``NOT IN``, one without."""
    items, orders = _gappy_items(s), _gappy_orders(s)
    unknown = orders.select(F.when(F.col("order_id") % 7 != 0, F.col("order_id")).alias("order_id"))
    cases = [
        ("missing parents", orders, True),
        ("a NULL among the parents", unknown, True),
        ("no parents", orders.where("order_id < 0"), True),
        ("NULL counts as missing", orders, False),
    ]
    parts = [
        quality.orphan_count(
            items, parents, "order_id", null_aware=rule, parent_unique=parent_unique
        ).select(F.lit(name).alias("situation"), "orphans")
        for name, parents, rule in cases
    ]
    return functools.reduce(DataFrame.unionAll, parts)


@query("o02g_orphans_in_gaps")
def _(s):
    return _orphans_in_gaps(s, parent_unique=False)


@query("o02j_orphans_in_gaps_by_join")
def _(s):
    return _orphans_in_gaps(s, parent_unique=True)


@query("o05_customer_totals")
def _(s):
    return quality.compare_counts(
        s.customers, s.orders, "customer_id", "TotalCustomers", "DistinctCustomersInOrders"
    )


@query("o06_null_profile")
def _(s):
    return delivery.lifecycle_gaps(s.orders)


@query("o07_missing_delivery_by_status")
def _(s):
    return delivery.missing_delivery_by_status(s.orders)


@query("o08_delivered_without_date")
def _(s):
    return delivery.delivered_without_date(s.orders)


# --- delivery ----------------------------------------------------------------------------------


@query("o09_worst_delays")
def _(s):
    return delivery.worst_delays(s.orders)


@query("o10_busiest_delivery_days")
def _(s):
    return delivery.busiest_delivery_days(s.orders)


@query("o11_severe_delays_on_day")
def _(s):
    return delivery.severe_delays_on_day(s.orders, SEVERE_DAY)


@query("o12_delay_stats")
def _(s):
    return delivery.delay_stats(s.orders)


@query("o13_median_delay")
def _(s):
    return delivery.median_delay(s.orders)


@query("o13e_median_exact_delay")
def _(s):
    """The median of the delays as they are, to the microsecond, without any list of them in one task."""
    late = delivery.delivered(s.orders).select(
        delay_seconds(delivery.ARRIVED, delivery.PROMISED).alias("late")
    )
    middle = ranking.order_statistics(late, "late")
    days = F.round(F.col("value").cast("double") / 86400, 6)
    return middle.select("rows", days.alias("median_delay"))


@query("o14q_payment_quartiles")
def _(s):
    """Smallest, quartiles and largest payment of each type."""
    return ranking.order_statistics(
        s.payments, "payment_value", [0, 0.25, 0.5, 0.75, 1], ["payment_type"], "payment_value"
    )


# --- payments and catalogue --------------------------------------------------------------------


@query("o14_payment_types")
def _(s):
    return payments.payment_summary(s.payments)


@query("s02_import_with_quarantine")
def _(s):
    """Payments through CSV files in which some lines are faulty: lines by reason, and the good amounts."""
    path = write_folder(s.spark, "payments_csv")
    key = F.col("order_id")
    value = F.when(key % 97 == 0, "n/a").when(key % 89 != 1, F.col("payment_value").cast("string"))
    fields = [key.cast("string"), F.when(key % 83 != 2, F.col("payment_type")), value]
    lines = F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields], F.when(key % 101 == 0, "more"))
    s.payments.select(lines.alias("order_id,payment_type,payment_value")).write.options(header=True, sep="\x01").csv(path)
    schema = "order_id long, payment_type string, payment_value double"
    read = import_csv(s.spark, path, T.StructType.fromDDL(schema), required=["payment_type", "payment_value"])
    good = read.rows.agg(F.round(exact_sum("payment_value").cast("double"), 2)).scalar()
    return read.counts().withColumn("good_value", F.when(F.col("reason") == "good", good))


@query("d05_payment_share")
def _(s):
    return payments.payment_share(s.payments)


@query("o15_top_categories")
def _(s):
    return catalog.revenue_by_category(s.order_items, s.products, s.translation)


@query("o16_category_avg_price")
def _(s):
    return catalog.category_average_price(
        s.order_items, s.products, s.translation, [DEAR, CHEAP]
    )


@query("d07_price_gap")
def _(s):
    return catalog.category_price_gap(s.order_items, s.products, s.translation, DEAR, CHEAP)


@query("o17_above_category_average")
def _(s):
    return catalog.above_category_average(s.order_items, s.products)


@query("d06_above_average_share")
def _(s):
    return catalog.above_average_share(s.order_items, s.products)


@query("o18_null_categories")
def _(s):
    return quality.missing_count(s.products, "product_category_name", "null_categories")


@query("d08_null_category_share")
def _(s):
    return quality.missing_share(s.products, "product_category_name", "null_category_share")


@query("o19_top3_per_category")
def _(s):
    return catalog.top_prices_per_category(s.order_items, s.products)


# --- geography ---------------------------------------------------------------------------------


def _centroids(s: SampleStore) -> DataFrame:
    return geo.centroid_by_key(s.geolocation)


def _stored_centroids(s: SampleStore) -> DataFrame:
    """The reduced positions as a stored table."""
    return store_and_read(_centroids(s), "geolocation_summary")


def _placed(s: SampleStore) -> DataFrame:
    return geo.order_geo(s.order_items, s.orders, s.customers, s.sellers, _centroids(s))


def _shipments(s: SampleStore) -> DataFrame:
    return geo.shipments(s.order_items, s.orders, s.customers, s.sellers, _centroids(s))


def _categorised(s: SampleStore) -> DataFrame:
    return geo.with_delay_category(_shipments(s))


def _facts(s: SampleStore) -> DataFrame:
    """The shipments with their category: joined once and stored, then read by every analysis."""
    return store_view(s, _categorised, "order_distance_delay")


@query("g01_geo_rows")
def _(s):
    return quality.row_count(s.geolocation, "Total_Geolocation_Rows")


@query("g02_zip_repetition")
def _(s):
    return geo.zip_repetition(s.geolocation)


@query("g03_geo_summary")
def _(s):
    return _centroids(s)


@query("g04_geo_summary_table")
def _(s):
    return _stored_centroids(s)


@query("g05_order_coordinates")
def _(s):
    return geo.order_coordinates(_placed(s))


@query("g06_order_distance")
def _(s):
    return geo.order_distance(_placed(s))


@query("g06d_dropped_items")
def _(s):
    return geo.dropped_items(s.order_items, s.orders, s.customers, s.sellers, _centroids(s))


@query("g07_distance_delay_v1")
def _(s):
    return store_and_read(_facts(s).select(geo.VERSION_1), "distance_delay_v1")


@query("g08_delay_by_distance_band")
def _(s):
    return geo.delay_by_distance_band(_facts(s))


@query("g09_distance_delay_v2")
def _(s):
    return store_and_read(_facts(s).select(geo.VERSION_2), "distance_delay_v2")


@query("g09v_delayed_pct")
def _(s):
    return kpi.delayed_rate(_facts(s))


@query("g10_distance_delay_v3")
def _(s):
    return store_and_read(_facts(s).select(geo.VERSION_3), "distance_delay_v3")


@query("g11_delay_category")
def _(s):
    """The category is one more column of the same projection, so the table is written once."""
    return store_and_read(_facts(s), "distance_delay_v4")


@query("g11r_category_in_place")
def _(s):
    """The shipments as a catalogue table, rebuilt over itself with the category as a new column."""
    name = new_table_name("order_distance_delay")
    stored = materialise(_facts(s).drop("DelayCategory"), name)
    materialise(geo.with_delay_category(stored), name, mode="overwrite")
    return s.spark.table(name).select(*geo.VERSION_3, "DelayCategory")


@query("g13r_kpi_rebuilt")
def _(s):
    """The shipments stored once; the KPI table read from them is dropped and built again."""
    shipped = materialise(_facts(s).select(geo.VERSION_3), new_table_name("order_distance_delay"))
    name = new_table_name("kpi_summary")
    materialise(kpi.kpi_summary(shipped, as_percent=True), name)
    return materialise(kpi.kpi_summary(shipped), name, mode="overwrite")


@query("g11p_category_by_partition")
def _(s):
    """The shipments by state, with the category as an added column of which only late states change."""
    name = new_table_name("order_distance_delay")
    store_partitioned(_facts(s).drop("DelayCategory"), name, ["customer_state"])
    add_column(s.spark, name, "DelayCategory", "string", "'unknown'")
    named = {"DelayCategory": delay_category("DeliveryDelayDays")}
    update(s.spark, name, ["customer_state"], F.col("customer_state") < "M", named)
    return s.spark.table(name).select("order_id", "customer_state", "DistanceKM", "DeliveryDelayDays", "DelayCategory")


@query("g13p_kpi_published")
def _(s):
    """The KPI table published twice; readers of the name see one version or the other."""
    name = new_table_name("kpi_summary")
    publish(kpi.kpi_summary(_facts(s), as_percent=True), name)
    return publish(kpi.kpi_summary(_facts(s)), name)


@query("g12_kpi_pct")
def _(s):
    return store_and_read(kpi.kpi_summary(_facts(s), as_percent=True), "kpi_summary_pct")


@query("g13_kpi_fraction")
def _(s):
    return store_and_read(kpi.kpi_summary(_facts(s)), "kpi_summary")


@query("d01_top_routes")
def _(s):
    return geo.top_routes(_facts(s))


@query("d02_freight_vs_distance")
def _(s):
    return geo.freight_vs_distance(_facts(s))


@query("d03_map_points")
def _(s):
    return geo.map_points(_facts(s), store_view(s, _centroids, "geolocation_summary"))


@query("d03t_map_tiles")
def _(s):
    """The map at every zoom level, from the whole world to tiles of a few kilometres."""
    points = geo.map_points(_facts(s), store_view(s, _centroids, "geolocation_summary"))
    return geo.map_tiles(points, ZOOM)


@query("d04_on_time_rate")
def _(s):
    return kpi.on_time_rate(_facts(s))


# --- forecast ----------------------------------------------------------------------------------


def _series(s: SampleStore) -> DataFrame:
    return forecast.monthly_revenue(
        s.order_items, s.orders, s.customers, s.products, keys=SERIES
    )


def _total(s: SampleStore) -> DataFrame:
    return forecast.monthly_revenue(s.order_items, s.orders)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rounded_forecast(df: DataFrame) -> DataFrame:
    return _rounded(df, 2, "yhat", "yhat_lower", "yhat_upper")


@query("f01_monthly_series")
def _(s):
    return _series(s)


@query("f01t_monthly_total")
def _(s):
    return _total(s)


@query("f01c_monthly_from_csv")
def _(s):
    """Monthly revenue written as CSV with 'YYYY-MM' months, read back and shaped as a series."""
    path = write_folder(s.spark, "monthly_revenue")
    month = F.date_format("ds", "yyyy-MM").alias("OrderMonth")
    _total(s).select(month, F.col("y").alias("MonthlyRevenue")).write.option("header", True).csv(
        path
    )
    return forecast.to_series(read_monthly(s.spark, path), "OrderMonth", "MonthlyRevenue")


@query("f02_trend_model")
def _(s):
    model = forecast.fit_trend(_series(s), SERIES)
    shown = model.select(*SERIES, "n", "slope", "intercept", "sigma")
    return _rounded(shown, 2, "slope", "intercept", "sigma")


@query("f02z_trend_zero_filled")
def _(s):
    """The line per series when months without sales count as zero."""
    filled = forecast.fill_months(_series(s), SERIES)
    shown = forecast.fit_trend(filled, SERIES).select(*SERIES, "n", "slope", "intercept", "sigma")
    return _rounded(shown, 2, "slope", "intercept", "sigma")


@query("f02t_trend_model_total")
def _(s):
    shown = forecast.fit_trend(_total(s)).select("n", "slope", "intercept", "sigma")
    return _rounded(shown, 2, "slope", "intercept", "sigma")


@query("f03_seasonal_model")
def _(s):
    """Line and two yearly waves per series, one column per coefficient."""
    model = forecast.fit_trend(_series(s), SERIES, yearly=True, order=WAVES)
    names = ["intercept", "slope", "sin_1", "cos_1", "sin_2", "cos_2"]
    coef = [F.round(F.col("coef")[i], 2).alias(name) for i, name in enumerate(names)]
    return model.select(*SERIES, "n", *coef, F.round("sigma", 2).alias("sigma"))


@query("f04_forecast")
def _(s):
    return _rounded_forecast(forecast.forecast(_series(s), SERIES))


@query("f04t_forecast_total")
def _(s):
    return _rounded_forecast(forecast.forecast(_total(s)))


@query("f04y_seasonal_forecast")
def _(s):
    predicted = forecast.forecast(_series(s), SERIES, yearly=True, order=WAVES)
    return _rounded_forecast(predicted)


@query("f05_last10")
def _(s):
    predicted = forecast.forecast(_series(s), SERIES)
    return _rounded_forecast(ranking.tail_by_time(predicted, SERIES, "ds", 10))


@query("f05t_last10_total")
def _(s):
    predicted = forecast.forecast(_total(s))
    return _rounded_forecast(ranking.tail_by_time(predicted, [], "ds", 10))


@query("f06_accuracy")
def _(s):
    return _rounded(forecast.accuracy(_series(s), SERIES), 2, "mae", "mape")


@query("f06t_accuracy_total")
def _(s):
    return _rounded(forecast.accuracy(_total(s)), 2, "mae", "mape")


@query("f07_export")
def _(s):
    exported = forecast.export_frame(forecast.forecast(_series(s), SERIES), SERIES)
    return _rounded_forecast(store_and_read(exported, "sales_forecast"))


@query("f07r_export_replaced")
def _(s):
    """The export twice into one table: first that of the whole shop, then the series over it."""
    name = new_table_name("sales_forecast")
    forecast.export_forecast(forecast.forecast(_total(s)), name)
    exported = forecast.export_forecast(forecast.forecast(_series(s), SERIES), name, SERIES)
    return _rounded_forecast(exported)


@query("f08_rolling_origin")
def _(s):
    """How wrong the line is one to six months after the month in which it was drawn."""
    return _rounded(outlook.rolling_origin(_series(s), SERIES), 2, "mae", "mape")


@query("f08t_rolling_origin_total")
def _(s):
    return _rounded(outlook.rolling_origin(_total(s)), 2, "mae", "mape")


@query("f02c_changing_trend")
def _(s):
    """Trend with changes of slope: strength of the penalty, and how well the trend fits."""
    model = outlook.fit_changes(_series(s), SERIES, changes=CHANGES)
    shown = model.select(*SERIES, "n", "strength", "freedom", "sigma")
    return _rounded(shown, 2, "freedom", "sigma")


@query("f04c_changing_forecast")
def _(s):
    return _rounded_forecast(outlook.forecast_changes(_series(s), SERIES, changes=CHANGES))


@query("f04b_simulated_forecast")
def _(s):
    """The next months of every series, with bounds from redrawn lines."""
    return _rounded_forecast(outlook.simulated_forecast(_series(s), SERIES, draws=DRAWS))
