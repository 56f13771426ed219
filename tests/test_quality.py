from __future__ import annotations

import random

import pytest
from plans import physical
from pyspark.sql import functions as F

from cartsight.operators import quality


def _keys(spark, values, name="k"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def _not_in(child, parent):
    """SQL NOT IN, by hand."""
    if not parent:
        return len(child)
    if None in parent:
        return 0
    return sum(c is not None and c not in parent for c in child)


@pytest.mark.parametrize("parent", [[1], [1, None], [], [None], [3, 3, 1], [1, 2]])
@pytest.mark.parametrize("child", [[1, 2, None], [], [None], [2, 2, 2, 1]])
def test_orphans_follow_not_in(spark, child, parent):
    left, right = _keys(spark, child), _keys(spark, parent, "p")
    (found,) = quality.orphan_count(left, right, "k", "p").first()
    (joined,) = quality.orphan_count(left, right, "k", "p", parent_unique=True).first()
    assert found == joined == _not_in(child, parent)
    left.createOrReplaceTempView("c")
    right.createOrReplaceTempView("p")
    (sql,) = spark.sql("SELECT count(*) FROM c WHERE k NOT IN (SELECT p FROM p)").first()
    assert found == sql


@pytest.mark.parametrize("parent", [[1], [1, None], []])
def test_orphans_by_match(spark, parent):
    child = [1, 2, None, 2]
    for unique in (False, True):
        (found,) = quality.orphan_count(
            _keys(spark, child), _keys(spark, parent), "k", null_aware=False, parent_unique=unique
        ).first()
        assert found == sum(c is None or c not in parent for c in child)


def test_orphans_with_one_dominant_key(spark):
    rng = random.Random(5)
    child = [7] * 400 + [rng.randrange(300) for _ in range(800)]
    parent = [rng.randrange(200) for _ in range(500)]
    (found,) = quality.orphan_count(_keys(spark, child), _keys(spark, parent), "k").first()
    assert found == _not_in(child, parent)


def test_orphans_need_no_join(sample):
    plan = physical(quality.orphan_count(sample.order_items, sample.orders, "order_id"))
    assert "Join" not in plan
    assert plan.count("partial_sum(in_child") == 1


def test_orphans_of_unique_parents_are_not_broadcast_blindly(sample, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    found = quality.orphan_count(sample.order_items, sample.orders, "order_id", parent_unique=True)
    plan = physical(found)
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Broadcast" not in plan


def test_duplicates(spark):
    found = quality.duplicate_keys(_keys(spark, [1, 1, 2, None, None, 3, 3, 3]), "k").collect()
    assert {tuple(r) for r in found} == {(1, 2), (None, 2), (3, 3)}
    assert quality.duplicate_keys(_keys(spark, [1, 2]), "k").count() == 0


def test_null_profile(spark):
    rows = [("a", 1, None), ("a", None, None), ("b", 3, 4)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    assert tuple(quality.null_profile(df, ["x", "y"]).first()) == (3, 1, 2)
    by = {r["g"]: tuple(r)[1:] for r in quality.null_profile(df, ["y"], by="g").collect()}
    assert by == {"a": (2, 2), "b": (1, 0)}
    empty = quality.null_profile(df.where("false"), ["x"]).first()
    assert tuple(empty) == (0, None)


def test_counts(spark):
    a, b = _keys(spark, [1, 2, 2, None]), _keys(spark, [5, 5, None, 6])
    assert tuple(quality.compare_counts(a, b, "k").first()) == (4, 2)
    assert tuple(quality.row_count(a.where("false")).first()) == (0,)
    assert tuple(quality.missing_count(a, "k").first()) == (1,)
    assert tuple(quality.missing_share(a, "k").first()) == (0.25,)
    assert tuple(quality.missing_share(a.where("false"), "k").first()) == (None,)


def test_row_count_reads_no_column(sample):
    assert "ReadSchema: struct<>" in physical(quality.row_count(sample.orders))


def test_reference_report_against_orphan_count(spark):
    """Bitmaps and the plain grouping agree: NULLs on either side, empty parents, negative and large keys."""
    rng = random.Random(7)
    key = lambda: rng.choice([None, rng.randrange(40), -rng.randrange(5), 32_768 * rng.randrange(3), 10**12 + rng.randrange(9)])

    def frame(n, nulls):
        rows = [(key(), key()) for _ in range(n)]
        rows = rows if nulls else [r for r in rows if None not in r]
        return spark.createDataFrame(rows, "a long, b long")

    tables = {"many": frame(400, True), "few": frame(60, False), "nulls": frame(30, True), "none": frame(0, True)}
    references = {
        f"{c}.{ck} {p}.{pk}": quality.Reference(c, ck, p, pk) for c in tables for p in tables for ck in "ab" for pk in "ab"
    }
    found = {r.reference: r.orphans for r in quality.reference_report(tables, references).collect()}
    for name, r in references.items():
        child, parent = tables[r.child], tables[r.parent]
        assert found[name] == quality.orphan_count(child, parent, r.child_key, r.parent_key).first()[0], name
    with pytest.raises(ValueError, match="whole numbers"):
        quality.reference_report({"t": spark.createDataFrame([("x",)], "k string")}, {"r": quality.Reference("t", "k", "t", "k")})


def test_bitmaps_shuffle_far_less_than_keys(spark):
    """Dense keys: bytes written to the shuffles of both ways, from the metrics of their plans."""
    import re

    child = spark.range(400_000, numPartitions=4).select((F.col("id") / 2).cast("long").alias("k"))
    parent = spark.range(200_000, numPartitions=4).withColumnRenamed("id", "k")

    def shuffled(df):
        df.collect()
        total, left = 0, [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                left.append(node.executedPlan())
            elif re.search("QueryStage", name):
                left.append(node.plan())
            else:
                if name == "Exchange":
                    total += node.metrics().apply("shuffleBytesWritten").value()
                left += [node.children().apply(i) for i in range(node.children().size())]
        return total

    plain = shuffled(quality.orphan_count(child, parent, "k"))
    compact = shuffled(
        quality.reference_report({"c": child, "p": parent}, {"r": quality.Reference("c", "k", "p", "k")})
    )
    assert 0 < 10 * compact < plain
