"""The commerce tables as DataFrames.

``FileStore`` scans a folder that holds one file or folder per table, ``TableStore`` the tables of a
catalogue database. ``SampleStore`` derives the same tables from the sample star schema with column
expressions, so that every operator can run on it; FIXTURES.md lists the expressions. All scan
lazily: a table is opened when it is first used, and Catalyst reads only the columns a query
touches.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.sources.schemas import COMMERCE, SAMPLE


def _strict(reader):
    """CSV options under which a file with another header, or a malformed number, is an error."""
    return reader.options(header=True, enforceSchema=False, mode="FAILFAST")


class FileStore:
    """Commerce tables in ``folder``, as ``<table>.parquet`` or ``<table>.csv``."""

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet"):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.fmt = fmt
        #: The paths of the tables that were opened.
        self.paths: set[str] = set()

    def _path(self, table: str) -> str:
        path = f"{self.folder}/{table}.{self.fmt}"
        self.paths.add(path)
        return path

    def _scan(self, table: str) -> DataFrame:
        schema = COMMERCE[table]
        path = self._path(table)
        if self.fmt != "csv":
            return self.spark.read.schema(schema).format(self.fmt).load(path)
        # A CSV reader matches by position: take the names from the header line, the types from
        # the schema, and leave out the columns nothing here uses.
        types = {f.name: f.dataType for f in schema}
        header = self.spark.read.option("header", True).csv(path).columns
        found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        rows = _strict(self.spark.read.schema(found)).csv(path)
        return rows.select(*schema.names)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in COMMERCE}

    def create_views(self) -> None:
        """Make every table available to ``spark.sql`` under its name."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)

    @cached_property
    def orders(self) -> DataFrame:
        return self._scan("orders")

    @cached_property
    def customers(self) -> DataFrame:
        return self._scan("customers")

    @cached_property
    def order_items(self) -> DataFrame:
        return self._scan("order_items")

    @cached_property
    def payments(self) -> DataFrame:
        return self._scan("payments")

    @cached_property
    def products(self) -> DataFrame:
        return self._scan("products")

    @cached_property
    def sellers(self) -> DataFrame:
        return self._scan("sellers")

    @cached_property
    def translation(self) -> DataFrame:
        return self._scan("translation")

    @cached_property
    def geolocation(self) -> DataFrame:
        return self._scan("geolocation")


class TableStore(FileStore):
    """Commerce tables in catalogue database ``folder``, bucketed or not."""

    def _scan(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.folder}.{table}").select(*COMMERCE[table].names)


class SampleStore(FileStore):
    """Commerce tables derived from the sample star schema in ``folder``."""

    def _scan(self, table: str) -> DataFrame:
        return self.spark.read.schema(SAMPLE[table]).parquet(self._path(table))

    @cached_property
    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        day = F.col("o_orderdate")
        in_transit = F.col("o_orderstatus") == "P"
        minutes = ((key * 7919) % 34567).cast("int")
        return self._scan("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(in_transit, "shipped").otherwise("delivered").alias("order_status"),
            day.alias("order_purchase_timestamp"),
            F.when(key % 617 != 0, day + F.make_dt_interval(hours=F.lit(1))).alias(
                "order_approved_at"
            ),
            F.when(key % 59 != 0, day + F.make_dt_interval(F.lit(2))).alias(
                "order_delivered_carrier_date"
            ),
            F.when(in_transit | (key % 1201 == 0), None)
            .when(key % 997 == 1, day + F.make_dt_interval(F.lit(170)))
            .otherwise(day + F.make_dt_interval(mins=minutes))
            .alias("order_delivered_customer_date"),
            (day + F.make_dt_interval((18 + key % 9).cast("int"))).alias(
                "order_estimated_delivery_date"
            ),
        )

    def _nation(self) -> DataFrame:
        return self._scan("nation").select("n_nationkey", "n_name")

    @cached_property
    def customers(self) -> DataFrame:
        return (
            self._scan("customer")
            .join(self._nation(), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                (F.col("c_custkey") % 97).alias("customer_zip_code_prefix"),
                F.col("n_name").alias("customer_state"),
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._scan("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self._scan("events").select(
            F.col("event_id").alias("order_id"),
            F.col("event_type").alias("payment_type"),
            F.col("value").alias("payment_value"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._scan("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 54 != 0, F.col("p_type")).alias("product_category_name"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self._scan("supplier")
            .join(self._nation(), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                ((F.col("s_suppkey") * 3) % 97).alias("seller_zip_code_prefix"),
                F.col("n_name").alias("seller_state"),
            )
        )

    @cached_property
    def translation(self) -> DataFrame:
        return (
            self._scan("part")
            .select(F.col("p_type").alias("product_category_name"))
            .where(F.col("p_type") != "PROMO")
            .distinct()
            .withColumn("product_category_name_english", F.lower("product_category_name"))
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        key = F.col("c_custkey")
        zip_code = key % 95
        return (
            self._scan("customer")
            .join(self._nation(), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                zip_code.alias("geolocation_zip_code_prefix"),
                (-30 + ((zip_code * 31) % 97) / 8 + (key % 7) / 1024).alias("geolocation_lat"),
                (-60 + ((zip_code * 53) % 97) / 8 + (key % 11) / 1024).alias("geolocation_lng"),
                F.col("c_name").alias("geolocation_city"),
                F.col("n_name").alias("geolocation_state"),
            )
        )
