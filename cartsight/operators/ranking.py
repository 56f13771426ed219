"""Top rows, overall, per group and per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartsight.functions import order_key

# An order key is read in digits of 16 bits, highest first.
_DIGIT_BITS, _DIGITS = 16, 4


def top_k(df: DataFrame, by: str, k: int, tiebreak: str | Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; equal values go to the smallest ``tiebreak``.

    Each task keeps its own ``k`` best rows, so nothing is sorted as a whole.
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_ranks(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, value, rank): the values that take the SQL ranks 1 to ``n`` in their group.

    ``df`` holds (group, value, copies), one row per distinct value. At most ``n`` values per group
    can reach rank ``n``, so each task sends at most ``n`` rows per group to the window, however
    many rows share a value. NULL values rank last.
    """
    best = Window.partitionBy(group).orderBy(F.desc_nulls_last(value))
    ahead = best.rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= n)
        .withColumn("rank", 1 + F.coalesce(F.sum("copies").over(ahead), F.lit(0)))
        .where(F.col("rank") <= n)
        .select(group, value, "rank")
    )


def tail_by_time(df: DataFrame, keys: Sequence[str], time: str, n: int) -> DataFrame:
    """The last ``n`` rows of every series; ``keys`` may be empty for a single series."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(time))
    return (
        df.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= n).drop("place")
    )


def upper_median(df: DataFrame, column: str, name: str = "median") -> DataFrame:
    """The element at position ``rows // 2`` of the sorted column; NULL sorts first.

    The column is first reduced to (value, copies). Only that reduced table is put in order, in one
    task, so the column should be rounded: delays to a tenth of a day give ten values per day of
    the calendar, whatever the number of rows.
    """
    values = df.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("copies"))
    ordered = Window.orderBy(F.asc_nulls_first(name))
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.select(
        name,
        "copies",
        F.sum("copies").over(running).alias("upto"),
        F.shiftright(F.sum("copies").over(everything), 1).alias("middle"),
    )
    here = (F.col("upto") > F.col("middle")) & (F.col("upto") - F.col("copies") <= F.col("middle"))
    return placed.where(here).select(name)


def order_statistics(
    df: DataFrame,
    column: str,
    at: Sequence[float] = (0.5,),
    keys: Sequence[str] = (),
    name: str = "value",
) -> DataFrame:
    """(keys..., at, rows, name): exact elements of the sorted column, for each group of ``keys``.

    ``at`` 0.5 is the element at position ``rows // 2``, as in :func:`upper_median`; 0 is the smallest
    and 1 the largest. NULL sorts first and NaN last; a group is never empty, and an empty table gives
    no rows. For whole numbers, doubles, dates, timestamps and decimals of up to 18 digits.

    The values are never put in order. Each has a key of 64 bits that sorts like it, which is read in
    four digits: rows are counted by their first digit, which tells the digit of the wanted element, then
    among the rows with that digit by the next, and so on. What is shuffled are the counters, at most
    65,536 a task and group, so it doesn't matter how many values there are or how they lie. The column
    is scanned four times. With ``keys``, the digits found so far join the rows; without, they are a
    row for each of ``at``, which is broadcast.
    """
    keyed = df.select(*keys, F.col(column).alias(name), order_key(column, df.schema[column].dataType).alias("_key"))
    targets = F.explode(F.array([F.lit(float(f)) for f in at]))

    def upto(level: int):
        """The first ``level`` digits of the key, as one number."""
        return F.shiftright("_key", _DIGIT_BITS * (_DIGITS - level))

    first = keyed.groupBy(*keys, upto(1).alias("_digits")).agg(
        F.count(F.lit(1)).alias("_copies"), F.min(name).alias(name)
    )
    counted = first.withColumn("rows", F.sum("_copies").over(Window.partitionBy(*keys))).withColumn("at", targets)
    place = F.least(F.floor(F.col("at") * F.col("rows")), F.col("rows") - 1).cast("long")
    found = _holding(counted.withColumn("_place", place), [*keys, "at"], "rows", name)
    for level in range(2, _DIGITS + 1):
        held = found.drop(name).withColumnsRenamed({**{k: f"_{k}" for k in keys}, "_digits": "_before"})
        same = upto(level - 1).eqNullSafe(F.col("_before"))
        for key in keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
        rows = keyed.join(held if keys else F.broadcast(held), same)
        counted = rows.groupBy(*keys, "at", "rows", "_place", upto(level).alias("_digits")).agg(
            F.count(F.lit(1)).alias("_copies"), F.min(name).alias(name)
        )
        found = _holding(counted, [*keys, "at"], "rows", name)
    return found.select(*keys, "at", "rows", name)


def _holding(counted: DataFrame, group: Sequence[str], *kept: str) -> DataFrame:
    """Of the counters of each group, in order, the one that holds the element at ``_place``, and the
    place of the element among its rows."""
    upto = F.sum("_copies").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("_digits")))
    before = F.col("_upto") - F.col("_copies")
    return (
        counted.withColumn("_upto", upto)
        .where((F.col("_upto") > F.col("_place")) & (before <= F.col("_place")))
        .select(*group, *kept, "_digits", (F.col("_place") - before).alias("_place"))
    )
