"""Stored tables: the only eager code in the package.

A stored table is how one stage hands over to the next: it cuts the lineage, survives the loss of
executors, and its file size is known, so Spark can decide on a broadcast from a real number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def materialise(
    df: DataFrame,
    name: str,
    mode: str = "errorifexists",
    bucket_by: str | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Store ``df`` as catalogue table ``name`` and return the stored table.

    ``mode="overwrite"`` builds the new table beside the old one and swaps the names afterwards.
    ``df`` may therefore read the very table it replaces, and a failed job leaves the old one. The
    name is missing only between the two renames, which move no data.

    ``bucket_by`` files the rows by a key. Two tables with the same buckets, such as orders and
    items by order, join without a shuffle. Adaptive execution cannot split a dominant key there,
    so leave it out where one order may hold a large part of the items.
    """
    spark = df.sparkSession

    def save(table: str, how: str) -> None:
        writer = df.write.mode(how).format("parquet")
        if bucket_by:
            writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
        writer.saveAsTable(table)

    if mode != "overwrite" or not spark.catalog.tableExists(name):
        save(name, mode)
        return spark.table(name)
    fresh = new_table_name(name)
    save(fresh, "errorifexists")
    old = f"{fresh}_old"
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    spark.sql(f"DROP TABLE {old}")
    return spark.table(name)


def new_table_name(name: str) -> str:
    """A catalogue name that starts with ``name``; two runs never meet."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``, or else the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def write_folder(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder; two runs never meet."""
    return f"{shared_folder(spark)}/cartsight/{name}-{uuid.uuid4().hex}"


def store_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it as read from there."""
    path = write_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
