"""What several operators share: the tables, stored intermediate results, folds and components."""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but a space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below the warehouse.

    Both are folders that every executor reaches. Two runs never meet.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    return f"{folder.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    This cuts the lineage: what is lost with an executor is read again, not computed again. Whole texts
    are worth a denser ``compression``, such as zstd.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """:func:`stored`, filed by ``key``, so that a join on it moves only the other side.

    Spark keeps such a layout in its catalogue: the table is an entry there, its files lie in the
    shared folder. Both can be dropped once the results are written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    entry = f"llm_{path.rsplit('/', 1)[1].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(entry)
    return spark.table(entry)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids count as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast(
        "int"
    )


def fold_of(doc_id: int | None, folds: int) -> int:
    """:func:`fold` for one id in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, only: int | None = None
) -> DataFrame:
    """(doc_id, y): up to ``most`` labelled ids outside the held-out fold, by hash order.

    The bound is part of the operators' interface. Ids that have contradicting labels are left
    out, as are ids without a label; ids without a document do no harm. With ``only``, ids with
    that label alone.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(fold("doc_id", folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .where("y = z")
    )
    if only is not None:
        known = known.where(F.col("y") == only)
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y")


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``chosen``, one for each id of a bounded choice, with a ``text`` of ``docs``.

    Where an id stands on several rows, the text with the smallest hash is taken. Each task keeps one
    text for each id, so no more than the choice is shuffled, however often an id repeats.
    """
    others = [c for c in chosen.columns if c != "doc_id"]
    rows = docs.select("doc_id", "text").join(chosen.hint("broadcast"), "doc_id")
    return rows.groupBy("doc_id", *others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it is connected to.

    Alternates large-star and small-star steps until nothing changes, which takes about
    log(longest chain) rounds. Each round is two groupings and two joins on Spark, is written to
    the shared folder, and sends only a count and a checksum to the driver.
    """
    now = stored(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m")
        )
        large = (
            both.join(low, F.col("a") == F.col("n"))
            .where("b > a AND b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = (
            large.join(least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(
                F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        now = stored(small, "edges")
        state = now.agg(
            F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
