"""From raw documents to a training mix, in five stages.

Each stage gets the session, the documents its predecessor kept and the folder of the other tables,
and gives a DataFrame. All but the last give the columns of the documents they got. NULL texts and
texts without letters go in the first stage; repeated rows and copies go in the second; NULL ids and
sources pass through all stages; extra columns are carried along up to the last. An empty table
passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartsight.llm import decontam, langid, mixing, pii, simhash
from cartsight.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows, by four tenths of the probability at least."""
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close SimHash fingerprints: the one with the smallest id."""
    return simhash.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced in the text.

    ``n_chars`` is counted anew where there is such a column.
    """
    found = pii.sanitised(docs, null_ids=True)
    columns = [
        F.col("text").alias(c)
        if c == "text"
        else F.length("text").cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return found.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in the order of training.

    doc_id, source, text, size, copy (from 0), copies and position. ``position`` is the training
    time of that copy; copy k is due k rounds of its source after the first.
    """
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            mixing.n_words("text").alias("size"),
            F.col("text").alias("text"),
            F.monotonically_increasing_id().alias("number"),  # ids may repeat or be NULL
        ),
        "texts",
        compression="zstd",
    )
    placed = stored(mixing.place(sized.drop("text")).where("copies > 0"), "placed")
    taken = sized.join(placed.select("number", "copies", "positions"), "number").select(
        "doc_id", "source", "text", "size", "copies", F.posexplode("positions").alias("copy", "position")
    )
    return taken.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
