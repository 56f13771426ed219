"""Explicit schemas. No reader in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "str": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "dbl": T.DoubleType(),
    "ts": T.TimestampNTZType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in columns.items()])


# The commerce tables the operators work on, as a shop would deliver them.
COMMERCE = {
    "orders": _schema(
        order_id="str",
        customer_id="str",
        order_status="str",
        order_purchase_timestamp="ts",
        order_approved_at="ts",
        order_delivered_carrier_date="ts",
        order_delivered_customer_date="ts",
        order_estimated_delivery_date="ts",
    ),
    "customers": _schema(
        customer_id="str", customer_zip_code_prefix="str", customer_state="str"
    ),
    "order_items": _schema(
        order_id="str",
        product_id="str",
        seller_id="str",
        price="dbl",
        freight_value="dbl",
    ),
    "payments": _schema(order_id="str", payment_type="str", payment_value="dbl"),
    "products": _schema(product_id="str", product_category_name="str"),
    "sellers": _schema(seller_id="str", seller_zip_code_prefix="str", seller_state="str"),
    "translation": _schema(product_category_name="str", product_category_name_english="str"),
    "geolocation": _schema(
        geolocation_zip_code_prefix="str",
        geolocation_lat="dbl",
        geolocation_lng="dbl",
        geolocation_city="str",
        geolocation_state="str",
    ),
}

# The sample star schema the tests and the benchmark read.
SAMPLE = {
    "nation": _schema(n_nationkey="int", n_name="str", n_regionkey="int"),
    "customer": _schema(
        c_custkey="long", c_name="str", c_nationkey="int", c_acctbal="dbl", c_mktsegment="str"
    ),
    "supplier": _schema(s_suppkey="long", s_name="str", s_nationkey="int", s_acctbal="dbl"),
    "part": _schema(
        p_partkey="long",
        p_name="str",
        p_brand="str",
        p_type="str",
        p_size="int",
        p_retailprice="dbl",
    ),
    "orders": _schema(
        o_orderkey="long",
        o_custkey="long",
        o_orderstatus="str",
        o_totalprice="dbl",
        o_orderdate="ts",
        o_orderpriority="str",
    ),
    "lineitem": _schema(
        l_orderkey="long",
        l_partkey="long",
        l_suppkey="long",
        l_linenumber="int",
        l_quantity="dbl",
        l_extendedprice="dbl",
        l_discount="dbl",
        l_tax="dbl",
        l_returnflag="str",
        l_linestatus="str",
        l_shipdate="ts",
    ),
    "events": _schema(
        event_id="long", ts="ts", user_id="long", event_type="str", value="dbl", props="str"
    ),
}

MONTHLY = _schema(OrderMonth="str", MonthlyRevenue="dbl")
