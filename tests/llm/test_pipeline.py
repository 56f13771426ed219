"""The pipeline against its rules, on the smallest sample and on hand-made rows."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cartsight.llm import decontam, langid, mixing, pii, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Every stage keeps just what its operator says, and run() gives what the stages give."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    first = corpus_pipeline.language_id(spark, docs, SF).cache()
    known = langid.predict(docs, langid.fit(docs)).where("lang_pred != 'und' AND score >= 0.4")
    assert {r[0] for r in first.select("doc_id").collect()} == {r[0] for r in known.select("doc_id").collect()}
    second = corpus_pipeline.near_dedup(spark, first, SF).cache()
    classes = simhash.components_of(first).where("doc_id = component_id")
    assert {r[0] for r in second.select("doc_id").collect()} == {r[0] for r in classes.select("doc_id").collect()}
    third = corpus_pipeline.decontaminate(spark, second, SF).cache()
    leaked = {r[0] for r in decontam.contaminated(second, bench).select("doc_id").collect()}
    assert {r[0] for r in third.select("doc_id").collect()} == {r[0] for r in second.select("doc_id").collect()} - leaked
    fourth = corpus_pipeline.hide_personal_data(spark, third, SF).cache()
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    assert fourth.count() == third.count()
    assert pii.find(fourth).agg(F.sum("n_email") + F.sum("n_phone") + F.sum("n_ip")).first()[0] == 0
    last = corpus_pipeline.mix_sources(spark, fourth, SF)
    taken = {(r.doc_id, r.copies) for r in mixing.mix(fourth).where("copies > 0").collect()}
    rows = last.collect()
    assert sorted((r.doc_id, r["copy"]) for r in rows) == sorted((d, k) for d, n in taken for k in range(n))
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, whole)) == sorted(map(str, rows))


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    extra = docs.selectExpr("*", "1 AS score", "'x' AS row", "2 AS fp", "3 AS copies")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0)], docs.schema)
    for rows in (extra, extra.limit(0), docs.unionByName(odd).unionByName(docs)):
        columns, now = rows.columns, rows
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == columns
        now.collect()


def test_copies_of_a_document_come_rounds_apart(spark):
    rows = [(i, "a" if i < 100 else "b", "w " * 10) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = corpus_pipeline.mix_sources(spark, docs, SF).where("source = 'a'").collect()
    assert [r.position for r in found] == sorted(r.position for r in found)
    assert [r["copy"] for r in found] == [k for k in range(3) for _ in range(100)]
    assert found[-1].position > 0.99


def test_mix_of_repeated_and_null_ids_meets_the_targets(spark):
    rows = [(None if i % 3 == 0 else i % 40, f"s{i % 4}", "w " * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.union(docs).select("source", mixing.n_words("text").alias("size"))
    wanted = {r.source: r.target for r in mixing.targets(sized).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs.union(docs), SF)
    taken = {r.source: r.words for r in mixed.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    assert taken.keys() == wanted.keys()
    assert all(abs(taken[s] - wanted[s]) <= 2.5 for s in wanted)


@pytest.mark.parametrize("name", ["pipeline", *(f"op{i}_" for i in range(1, 11))])
def test_registered(name):
    assert any(q.startswith(name) for q in __spark_entry__.queries())
