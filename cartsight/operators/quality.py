"""Is the data fit for analysis: unique keys, intact references, missing values."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """One row with the number of rows; no column is read for it."""
    return df.agg(F.count(F.lit(1)).alias(name))


def duplicate_keys(df: DataFrame, key: str, above: int = 1) -> DataFrame:
    """Keys that occur more than ``above`` times, with the number of occurrences."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > above)
    )


def orphan_count(
    child: DataFrame,
    parent: DataFrame,
    key: str,
    parent_key: str | None = None,
    null_aware: bool = True,
    parent_unique: bool = False,
    name: str = "orphans",
) -> DataFrame:
    """Number of child rows whose key is missing from the parent.

    With ``null_aware`` the answer is that of SQL ``NOT IN``: no parent rows at all make every
    child row an orphan, one NULL among the parent keys makes none, and a NULL child key is never
    an orphan otherwise. Without it a NULL child key has no parent and counts. Neither side has to
    fit in memory, as it must for the broadcast behind ``NOT IN``.

    By default both key columns go through one grouping that counts occurrences per side. Each task
    combines equal keys before the shuffle, so a key that holds a large part of either table
    travels as one row per task. ``parent_unique`` says that the key identifies the parent rows, as
    for items and their orders. Then an anti join answers with less work, and adaptive execution
    splits a dominant child key. The result is the same even if the claim is wrong.
    """
    parents = parent.select(F.col(parent_key or key).alias("k"))
    children = child.select(F.col(key).alias("k"))
    if parent_unique:
        return _orphans_by_join(children, parents, null_aware, name)
    return _orphans_by_group(children, parents, null_aware, name)


def _orphans_by_group(
    children: DataFrame, parents: DataFrame, null_aware: bool, name: str
) -> DataFrame:
    sides = children.select("k", F.lit(1).alias("in_child"), F.lit(0).alias("in_parent")).unionAll(
        parents.select("k", F.lit(0), F.lit(1))
    )
    keys = sides.groupBy("k").agg(
        F.sum("in_child").alias("children"), F.sum("in_parent").alias("parents")
    )

    def total(what: Column) -> Column:
        return F.coalesce(F.sum(what), F.lit(0))

    found = F.col("children")
    unmatched = F.col("parents") == 0
    if not null_aware:
        return keys.agg(total(F.when(unmatched | F.col("k").isNull(), found)).alias(name))
    return keys.agg(
        F.when(total(F.col("parents")) == 0, total(found))
        .when(total(F.when(F.col("k").isNull(), F.col("parents"))) > 0, F.lit(0))
        .otherwise(total(F.when(unmatched & F.col("k").isNotNull(), found)))
        .alias(name)
    )


def _orphans_by_join(
    children: DataFrame, parents: DataFrame, null_aware: bool, name: str
) -> DataFrame:
    # NULL keys stay out of the join, where all of them would meet in one partition.
    keyed = children.where(F.col("k").isNotNull())
    unmatched = keyed.join(parents, "k", "left_anti")
    rows, filled = F.count(F.lit(1)), F.count("k")
    if not null_aware:
        return unmatched.agg((rows + children.agg(rows - filled).scalar()).alias(name))
    known = parents.agg(F.struct(rows.alias("rows"), filled.alias("filled"))).scalar()
    return unmatched.agg(
        F.when(known["rows"] == 0, children.agg(rows).scalar())
        .when(known["filled"] < known["rows"], F.lit(0))
        .otherwise(rows)
        .alias(name)
    )


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` refer by ``child_key`` to ``parent_key`` of ``parent``; tables go by name."""

    child: str
    child_key: str
    parent: str
    parent_key: str


def _keys(tables: Mapping[str, DataFrame], columns: Mapping[str, set[tuple[str, str]]]) -> DataFrame:
    """(tag, k): for each tag a row for every key of its column; each table is scanned once.

    ``columns`` says for each table which (tag, column) to read.
    """
    parts = []
    for table, wanted in sorted(columns.items()):
        df = tables[table]
        for _, column in wanted:
            if not isinstance(df.schema[column].dataType, T.IntegralType):
                raise ValueError(f"{table}.{column} has no whole numbers; use orphan_count")
        tagged = [F.struct(F.lit(tag).alias("tag"), F.col(c).cast("long").alias("k")) for tag, c in sorted(wanted)]
        parts.append(df.select(F.explode(F.array(*tagged)).alias("t")).select("t.*"))
    return functools.reduce(DataFrame.unionAll, parts)


def reference_report(tables: Mapping[str, DataFrame], references: Mapping[str, Reference]) -> DataFrame:
    """(reference, orphans): :func:`orphan_count`, with the rules of ``NOT IN``, for many references.

    For keys that are numbered more or less densely. Each task turns the keys of a column into bitmaps
    of 32,768 keys, 4 KB each however many rows there are; only these are shuffled, and every table is
    scanned once for all its columns. Where a bitmap holds keys that the parents lack, a second scan
    counts the rows of just these buckets. Sparse keys, or texts, are better off with
    :func:`orphan_count`, as a bitmap then holds few keys.
    """
    columns: dict[str, set[tuple[str, str]]] = {}
    for r in references.values():
        for table, column in ((r.child, r.child_key), (r.parent, r.parent_key)):
            columns.setdefault(table, set()).add((f"{table}.{column}", column))
    bucket = F.call_function("bitmap_bucket_number", F.col("k"))
    place = F.call_function("bitmap_bit_position", F.col("k"))
    sets = (
        _keys(tables, columns)
        .groupBy("tag", bucket.alias("bucket"))
        .agg(F.call_function("bitmap_construct_agg", place).alias("bits"), F.count(F.lit(1)).alias("rows"))
    )
    sides = F.explode(
        F.filter(
            F.array(
                *[
                    F.when(F.col("tag") == f"{table}.{column}", F.struct(F.lit(name).alias("reference"), F.lit(side).alias("side")))
                    for name, r in sorted(references.items())
                    for side, table, column in (("child", r.child, r.child_key), ("parent", r.parent, r.parent_key))
                ]
            ),
            lambda s: s.isNotNull(),
        )
    )
    of_parent = F.when(F.col("side") == "parent", F.col("bits"))
    by_side = {side: F.sum(F.when(F.col("side") == side, F.col("rows")).otherwise(0)) for side in ("child", "parent")}
    merge = lambda bits: F.call_function("bitmap_or_agg", bits)
    count = lambda bits: F.call_function("bitmap_count", bits)
    met = (
        sets.select("bucket", "bits", "rows", sides.alias("s"))
        .select("s.*", "bucket", "bits", "rows")
        .groupBy("reference", "bucket")
        .agg(
            (count(merge(F.col("bits"))) - count(merge(of_parent))).alias("missing"),
            merge(of_parent).alias("known"),
            by_side["child"].alias("children"),
            by_side["parent"].alias("parents"),
        )
    )
    sums = met.groupBy("reference").agg(
        F.sum("children").alias("children"),
        F.sum("parents").alias("parents"),
        F.sum(F.when(F.col("bucket").isNull(), F.col("parents")).otherwise(0)).alias("unknown"),
    )
    again: dict[str, set[tuple[str, str]]] = {}
    for name, r in references.items():
        again.setdefault(r.child, set()).add((name, r.child_key))
    gaps = met.where((F.col("missing") > 0) & F.col("bucket").isNotNull()).select("reference", "bucket", "known")
    rows = _keys(tables, again).where(F.col("k").isNotNull()).select(F.col("tag").alias("reference"), "k", bucket.alias("bucket"))
    byte = F.conv(F.hex(F.substring(F.col("known"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1
    lost = rows.join(gaps, ["reference", "bucket"]).where(~known).groupBy("reference").agg(F.count("k").alias("lost"))
    answer = (
        F.when(F.col("parents") == 0, F.col("children"))
        .when(F.col("unknown") > 0, F.lit(0))
        .otherwise(F.coalesce("lost", F.lit(0)))
    )
    names = F.explode(F.array(*[F.lit(n) for n in sorted(references)])).alias("reference")
    every = sets.sparkSession.range(1).select(names)
    zero = F.coalesce("children", F.lit(0)), F.coalesce("parents", F.lit(0)), F.coalesce("unknown", F.lit(0))
    joined = every.join(sums, "reference", "left").join(lost, "reference", "left")
    filled = joined.select("reference", "lost", *[z.alias(n) for z, n in zip(zero, ("children", "parents", "unknown"))])
    return filled.select("reference", answer.alias("orphans"))


def compare_counts(
    table: DataFrame,
    other: DataFrame,
    key: str,
    total_name: str = "total_rows",
    distinct_name: str = "distinct_keys",
) -> DataFrame:
    """One row: rows of ``table`` beside the distinct non-NULL ``key`` values of ``other``."""
    total = table.agg(F.count(F.lit(1))).scalar()
    distinct = other.agg(F.count_distinct(key)).scalar()
    one_row = table.sparkSession.range(0, 1, numPartitions=1)
    return one_row.select(total.alias(total_name), distinct.alias(distinct_name))


def null_profile(
    df: DataFrame,
    columns: Sequence[str] | dict[str, str],
    by: str | None = None,
    total_name: str = "total",
) -> DataFrame:
    """Row count and NULL count per column in one pass, for the table or per value of ``by``.

    ``columns`` may map a column to the name of its count. On an empty table the counts are NULL,
    as a plain SQL sum gives.
    """
    if not isinstance(columns, dict):
        columns = {c: f"null_{c}" for c in columns}
    counts = [
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(name) for c, name in columns.items()
    ]
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias(total_name), *counts)


def missing_count(df: DataFrame, column: str, name: str = "missing") -> DataFrame:
    """Number of rows without a value in ``column``."""
    return row_count(df.where(F.col(column).isNull()), name)


def missing_share(df: DataFrame, column: str, name: str = "missing_share") -> DataFrame:
    """Share of rows without a value in ``column``, to 4 places."""
    missing = F.sum(F.when(F.col(column).isNull(), 1).otherwise(0))
    return df.agg(F.round(F.try_divide(missing, F.count(F.lit(1))), 4).alias(name))
