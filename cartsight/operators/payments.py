"""How customers pay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartsight.functions import exact_mean, exact_sum


def payment_summary(payments: DataFrame) -> DataFrame:
    """Transactions, mean and total value per payment type, most used first."""
    total = exact_sum("payment_value").cast("double")
    return (
        payments.groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.round(exact_mean("payment_value"), 2).alias("avg_payment_value"),
            F.round(total, 2).alias("total_payment_value"),
        )
        .orderBy(F.desc("total_transactions"), "payment_type")
    )


def payment_share(payments: DataFrame) -> DataFrame:
    """Share of each payment type among all transactions, to 4 places."""
    per_type = payments.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("total_transactions")
    )
    everything = per_type.agg(F.sum("total_transactions")).scalar()
    return per_type.select(
        "payment_type",
        "total_transactions",
        F.round(F.col("total_transactions") / everything, 4).alias("share"),
    )
