"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartsight.llm import (
    bwt_dedup,
    byte_bpe,
    decontam,
    langid,
    merkle,
    mixing,
    pii,
    prefix_trie,
    quality_gam,
    quality_rules,
    rlz_dedup,
    simhash,
    toxicity,
)
from cartsight.llm.common import labelled_sample, table

#: Labelled documents that the CRF of the quality rules learns from.
CRF_DOCUMENTS = 1000


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chosen = labelled_sample(docs, labels, "quality", 4, 2, CRF_DOCUMENTS)
    return quality_rules.judge(docs, chosen)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 3).alias("target"),
        "taken",
        F.round("position", 9).alias("position"),
        F.round(F.element_at("positions", -1), 9).alias("last_position"),
    )


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.removed(table(spark, sf_dir, "documents")).drop("kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.removed(table(spark, sf_dir, "documents")).drop("kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        rank_file = file.read()
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)
    both = byte_bpe.decode(encoded, rank_file)
    as_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(as_text, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("key")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash,
        op3_mixing,
        op4_quality_gam,
        op5_language_id,
        op6_suffix_dedup,
        op7_substring_dedup,
        op8_decontamination,
        op9_toxicity,
        op10_pii,
        op11_byte_bpe,
        op12_merkle,
        op13_prefix_trie,
    )
}
ORACLES = {
    "op3_mixing": mixing.POSITIONS_ORACLE,
    "op6_suffix_dedup": bwt_dedup.ORACLE,
    "op7_substring_dedup": rlz_dedup.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
