"""Monthly revenue kept as a small CSV file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartsight.sources.schemas import MONTHLY


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Read (OrderMonth 'YYYY-MM', MonthlyRevenue) with a header; CRLF line ends are fine.

    Other column names, or a malformed number, are an error.
    """
    reader = spark.read.schema(MONTHLY)
    return reader.options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)
