from __future__ import annotations

import datetime as dt
import math
import random
import struct
from decimal import Decimal

import pytest
from plans import physical
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.functions import order_key
from cartsight.operators import catalog, delivery, ranking


@pytest.mark.parametrize("n", range(1, 8))
def test_upper_median_position(spark, n):
    values = [float(v) for v in range(n)]
    random.Random(n).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in ranking.upper_median(df, "v").collect()] == [sorted(values)[n // 2]]


@pytest.mark.parametrize(
    "values",
    [[1.0, 1.0, 2.0], [1.0, 2.0, 2.0, 2.0], [None, 1.0], [None, None, 1.0], [3.0, -1.0, 3.0, -1.0]],
)
def test_upper_median_ties_and_nulls(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    placed = sorted(values, key=lambda v: (v is not None, v or 0))
    assert [r[0] for r in ranking.upper_median(df, "v").collect()] == [placed[len(placed) // 2]]


def test_upper_median_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ranking.upper_median(df, "v").collect() == []


def test_top_k_keeps_ties_in_order(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 5)], "id int, v int")
    assert [r["id"] for r in ranking.top_k(df, "v", 3, "id").collect()] == [2, 1, 3]


def test_top_k_sorts_no_whole_table(sample):
    plan = physical(delivery.worst_delays(sample.orders))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def _items(spark, rows):
    return spark.createDataFrame(rows, "order_id long, product_id long, price double")


def _products(spark, rows):
    return spark.createDataFrame(rows, "product_id long, product_category_name string")


def _ranked(items, category_of, n):
    """Rank the item rows of each category by hand."""
    out = []
    for _, product, price in items:
        category = category_of.get(product)
        if category is None:
            continue
        rivals = [p for _, q, p in items if category_of.get(q) == category]
        if price is None:
            ahead = sum(p is not None for p in rivals)
        else:
            ahead = sum(p is not None and p > price for p in rivals)
        if ahead < n:
            out.append((category, product, price, ahead + 1))
    return sorted(out, key=str)


def _top(spark, items, category_of, n=3):
    found = catalog.top_prices_per_category(
        _items(spark, items), _products(spark, list(category_of.items())), n
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_top_prices_shared_ranks(spark):
    items = [(1, 1, 9.0), (2, 1, 9.0), (3, 2, 9.0), (4, 2, 8.0), (5, 1, 7.0)]
    category_of = {1: "a", 2: "a"}
    found = _top(spark, items, category_of)
    assert found == _ranked(items, category_of, 3)
    assert [r[3] for r in found] == [1, 1, 1]
    assert sorted(r[3] for r in _top(spark, items, category_of, 4)) == [1, 1, 1, 4]


def test_top_prices_missing_prices_and_categories(spark):
    items = [(1, 1, 5.0), (2, 1, None), (3, 1, None), (4, 2, 3.0), (5, 3, 90.0), (6, 2, 1.0)]
    category_of = {1: "a", 2: "b", 3: None}
    found = _top(spark, items, category_of)
    assert found == _ranked(items, category_of, 3)
    assert ("a", 1, None, 2) in found


@pytest.mark.parametrize("seed", range(3))
def test_top_prices_random(spark, seed):
    rng = random.Random(seed)
    category_of = {p: rng.choice(["a", "b", "c", None]) for p in range(12)}
    items = [
        (i, rng.randrange(14), rng.choice([rng.randrange(400) / 100, 3.5, None]))
        for i in range(300)
    ]
    items += [(i, 3, 4.25) for i in range(150)]
    assert _top(spark, items, category_of) == _ranked(items, category_of, 3)


def test_top_prices_cut_before_the_window(sample):
    plan = physical(catalog.top_prices_per_category(sample.order_items, sample.products))
    assert plan.count("WindowGroupLimit") >= 2


def test_tail_by_time(spark):
    rows = [("a", d) for d in range(5)] + [("b", 1), (None, 1), (None, 2), (None, 3)]
    df = spark.createDataFrame(rows, "s string, ds int")
    found = {tuple(r) for r in ranking.tail_by_time(df, ["s"], "ds", 2).collect()}
    assert found == {("a", 3), ("a", 4), ("b", 1), (None, 2), (None, 3)}
    single = {r["ds"] for r in ranking.tail_by_time(df.where("s = 'a'"), [], "ds", 3).collect()}
    assert single == {2, 3, 4}


def _bits(x):
    if x is None:
        return None
    if math.isnan(x):
        return 2**63 - 1
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def test_order_key_is_the_bits_of_a_double(spark):
    rng = random.Random(2)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(5000)]
    for k in range(-1074, 1024):
        values += [2.0**k, -(2.0**k), math.nextafter(2.0**k, 0), math.nextafter(2.0**k, math.inf)]
    values += [0.0, -0.0, math.inf, -math.inf, math.nan, None, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", order_key("v", T.DoubleType()).alias("key")).collect():
        assert row.key == _bits(row.v), row.v


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics_with_ties_nulls_and_groups(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, 0.0, -0.0, math.nan, math.inf, rng.gauss(0, 1), float(rng.randrange(4))])
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), pick()) for _ in range(rng.choice([1, 50, 700]))]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    at = [0, 0.1, 0.5, 0.5000001, 1]
    found = {(r.g, r.h, r["at"]): (r.rows, str(r.value)) for r in ranking.order_statistics(df, "v", at, ["g", "h"]).collect()}
    expected = {}
    for g, h in {r[:2] for r in rows}:
        own = sorted((r[2] for r in rows if r[:2] == (g, h)), key=lambda v: (v is not None, _bits(v) or 0))
        for f in at:
            value = own[min(int(f * len(own)), len(own) - 1)]
            expected[g, h, f] = (len(own), str(0.0 if value == 0 else value))
    assert {k: (n, v.replace("-0.0", "0.0") if v == "-0.0" else v) for k, (n, v) in found.items()} == expected


def test_order_statistics_of_a_million_values(spark):
    df = spark.range(1_000_000).select((F.rand(3) * 1000 - 200).alias("v"))
    values = sorted(r.v for r in df.collect())
    found = ranking.order_statistics(df, "v", [0, 0.25, 0.5, 1]).collect()
    assert {r["at"]: r.value for r in found} == {0: values[0], 0.25: values[250_000], 0.5: values[500_000], 1: values[-1]}


def test_order_statistics_of_other_types(spark):
    day, now = dt.date(2020, 1, 31), dt.datetime(2020, 1, 31, 12, 30, 15, 123456)
    rows = [(i - 5, Decimal(i - 5) / 100, day + dt.timedelta(i), now + dt.timedelta(days=i, microseconds=i), i > 3) for i in range(9)]
    df = spark.createDataFrame(rows, "i long, d decimal(10,2), day date, t timestamp_ntz, b boolean").repartition(3)
    df = df.withColumn("ts", F.col("t").cast("timestamp"))
    for column in ("i", "d", "day", "t", "ts", "b"):
        values = sorted(r[column] for r in df.collect())
        assert ranking.order_statistics(df, column).first().value == values[4]
    with pytest.raises(ValueError, match="order key"):
        ranking.order_statistics(df.select(F.lit("x").alias("s")), "s")
    assert ranking.order_statistics(df.where("i > 99"), "i").collect() == []


def test_order_statistics_shuffle_counters_only(spark):
    plan = physical(ranking.order_statistics(spark.range(1000).select((F.col("id") / 7).alias("v")), "v"))
    for line in plan.splitlines():
        assert "Exchange hashpartitioning(v" not in line and "rangepartitioning" not in line
    assert plan.count("partial_count") == 4 and "CartesianProduct" not in plan
