"""CSV files with faulty lines: the good rows, and every bad line once, with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.sources.stored import store_and_read

_LINE = "_line"
WRONG_FIELDS, WRONG_TYPE, MISSING = "wrong number of fields", "value not of its type", "missing "


@dataclass
class Import:
    """``rows`` has the columns asked for, ``quarantine`` line, file and reason of the lines left out."""

    rows: DataFrame
    quarantine: DataFrame

    def counts(self) -> DataFrame:
        """(reason, lines): how many lines were left out for each reason, and, as 'good', how many not."""
        bad = self.quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
        return bad.unionByName(self.rows.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("lines")))


def import_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> Import:
    """Read CSV with a header line, in one pass; nothing that a line holds is an error.

    Columns may come in any order and be more than ``schema`` names; a column that is not there at all
    is an error. A line with too few or too many fields, with a value that is not of its type, or
    without a value in one of ``required`` goes to the quarantine as it stands, under the first of
    these reasons that holds. Good and bad lines together are all lines. Both are stored, so the files
    are parsed once however often the result is read.
    """
    header = spark.read.option("header", True).csv(path).columns
    absent = [f.name for f in schema if f.name not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    kinds = {f.name: f.dataType for f in schema}
    texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
    found = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    line = T.StructField(_LINE, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE}
    read = spark.read.schema(T.StructType([*found, line])).options(header=True, enforceSchema=False, **options).csv(path)
    # As texts, only the number of fields can be wrong.
    as_texts = F.from_csv(F.col(_LINE), ", ".join(f"`{f.name}` string" for f in T.StructType([*texts, line])), options)
    reason = F.when(
        F.col(_LINE).isNotNull(), F.when(as_texts[_LINE].isNotNull(), WRONG_FIELDS).otherwise(WRONG_TYPE)
    )
    for c in required:
        reason = reason.when(F.col(c).isNull(), MISSING + c)
    whole = F.coalesce(F.col(_LINE), F.to_csv(F.struct(*header)))
    rows = store_and_read(
        read.select(
            *schema.names,
            reason.alias("_reason"),
            F.when(reason.isNotNull(), whole).alias(_LINE),
            F.col("_metadata.file_path").alias("_file"),
        ),
        "import",
    )
    bad = rows.where(F.col("_reason").isNotNull())
    return Import(
        rows.where(F.col("_reason").isNull()).select(*schema.names),
        bad.select(F.col(_LINE).alias("line"), F.col("_file").alias("file"), F.col("_reason").alias("reason")),
    )
