"""The two kinds of join that need more than ``DataFrame.join``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_by_group(
    rows: DataFrame, lookup: DataFrame, group: str, spread_by: str, slots: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, one or a few rows per value of ``group``.

    Meant for groups such as a category or a zip prefix, where one value may hold a large part of
    ``rows``. The rows of a group go to ``slots`` places by a hash of ``spread_by``, a column that
    differs within the group, and ``lookup`` is repeated for each slot. By default there is a slot for
    every eight shuffle partitions, but no fewer than eight, so that the spread grows with the job. That also puts a plain
    shuffle on both sides, which lets adaptive execution cut up a partition that is still too
    large; directly on top of an aggregate it cannot. If Spark knows or measures that ``lookup`` is
    small it broadcasts it instead, at most ``slots`` times the size that counts as small.
    """
    if slots is None:
        slots = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    placed = rows.withColumn("_slot", F.pmod(F.xxhash64(spread_by), F.lit(slots)))
    each = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))
    repeated = lookup.withColumn("_slot", F.explode(each))
    return placed.join(repeated, [group, "_slot"]).drop("_slot")


def join_facts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that both grow with the business, such as items and orders.

    Always shuffled and merged. Without the hint Spark may hash and broadcast one of them as long
    as its columns are small on disk, and then a single task per file of the other does the rest.
    Adaptive execution splits the partition of a key that holds a large part of the rows.
    """
    return left.join(right.hint("merge"), key)
