from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from plans import physical
from pyspark.sql import functions as F

from cartsight.operators import forecast, ranking
from cartsight.sources import read_monthly
from cartsight.sources.schemas import COMMERCE

# Twenty months of revenue, January 2017 to August 2018.
REVENUE = [
    111798.36, 234223.4, 359198.85, 340669.68, 489338.25, 421923.37, 481604.52, 554699.7,
    607399.67, 648247.65, 987765.37, 726033.19, 924645.0, 826437.13, 953356.25, 973534.09,
    977544.69, 856077.86, 867953.46, 838576.64,
]


def _month(i, year=2017):
    return dt.date(year + i // 12, i % 12 + 1, 1)


def _series(spark, values, year=2017):
    rows = [(_month(i, year), v) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "ds date, y double")


@pytest.fixture
def shipped_months(spark, tmp_path):
    """The twenty months as a CSV file with CRLF line ends, read back."""
    path = tmp_path / "monthly.csv"
    lines = ["OrderMonth,MonthlyRevenue"]
    lines += [f"{_month(i):%Y-%m},{v}" for i, v in enumerate(REVENUE)]
    path.write_bytes("\r\n".join(lines).encode())
    return forecast.to_series(read_monthly(spark, str(path)), "OrderMonth", "MonthlyRevenue")


def test_csv_series(shipped_months):
    rows = shipped_months.orderBy("ds").collect()
    assert [tuple(r) for r in rows] == [(_month(i), v) for i, v in enumerate(REVENUE)]


def test_trend_of_the_twenty_months(shipped_months):
    model = forecast.fit_trend(shipped_months).first()
    assert model["n"] == 20
    assert model["slope"] == pytest.approx(41641.1893, abs=1e-3)
    assert model["intercept"] == pytest.approx(263460.0577, abs=1e-3)
    predicted = forecast.forecast(shipped_months)
    rows = predicted.orderBy("ds").collect()
    assert len(rows) == 26
    assert rows[20]["yhat"] == pytest.approx(1096283.84, abs=0.01)
    assert rows[25]["yhat"] == pytest.approx(1304489.79, abs=0.01)
    assert rows[25]["ds"] == dt.date(2019, 2, 1)
    assert rows[25]["yhat_lower"] == pytest.approx(1121137.11, abs=0.01)
    assert rows[25]["yhat_upper"] == pytest.approx(1487842.47, abs=0.01)
    errors = forecast.score(shipped_months, predicted).first()
    assert errors["mae"] == pytest.approx(82834.39, abs=0.01)
    assert errors["mape"] == pytest.approx(17.498, abs=1e-3)


def test_last_ten_are_four_known_and_six_new(shipped_months):
    last = ranking.tail_by_time(forecast.forecast(shipped_months), [], "ds", 10)
    assert sorted(r["ds"] for r in last.collect()) == [_month(i) for i in range(16, 26)]


def test_exact_line(spark):
    series = _series(spark, [100.0 + 5 * i for i in range(15)])
    predicted = forecast.forecast(series, periods=3, level=0.95)
    rows = predicted.orderBy("ds").collect()
    assert [r["yhat"] for r in rows] == pytest.approx([100 + 5 * i for i in range(18)])
    errors = forecast.score(series, predicted).first()
    assert errors["mae"] == pytest.approx(0, abs=1e-6)
    assert rows[-1]["yhat_upper"] - rows[-1]["yhat_lower"] == pytest.approx(0, abs=1e-4)


def test_missing_month_keeps_its_place(spark):
    series = _series(spark, [10.0, 20.0, "gap", 40.0, 50.0])
    model = forecast.fit_trend(series).first()
    assert (model["n"], round(model["slope"], 9), round(model["intercept"], 9)) == (4, 10, 10)
    assert forecast.extend_months(series, periods=2).count() == 6


def test_short_series(spark):
    two = forecast.forecast(_series(spark, [1.0, 2.0])).orderBy("ds").collect()
    assert [r["yhat"] for r in two] == pytest.approx([1, 2, 3, 4, 5, 6, 7, 8])
    assert all(r["yhat_lower"] is None for r in two)
    one = forecast.forecast(_series(spark, [5.0])).collect()
    assert len(one) == 7 and all(r["yhat"] is None for r in one)
    assert forecast.forecast(_series(spark, []).where("false")).count() == 0


def test_zero_values_do_not_divide(spark):
    series = _series(spark, [0.0, 1.0, 2.0, 3.5])
    errors = forecast.score(series, forecast.forecast(series)).first()
    assert math.isfinite(errors["mape"]) and errors["mae"] > 0


def test_fill_months(spark):
    rows = [("a", _month(0), 1.0), ("a", _month(3), 2.0), ("b", _month(5), 9.0)]
    series = spark.createDataFrame(rows, "k string, ds date, y double")
    found = {tuple(r) for r in forecast.fill_months(series, ["k"]).collect()}
    assert found == set(rows) | {("a", _month(1), 0.0), ("a", _month(2), 0.0)}
    months = forecast.forecast(series, ["k"], periods=2, fill=0.0).groupBy("k").count()
    assert {tuple(r) for r in months.collect()} == {("a", 6), ("b", 3)}


def _seasonal(seed, months):
    rng = random.Random(seed)
    return [
        5000 * (seed + 1) + 40 * i + 900 * math.sin(2 * math.pi * i / 12) + rng.gauss(0, 50)
        for i in range(months)
    ]


def _design(months, year_offset=0):
    i = np.arange(months)
    angle = 2 * np.pi * (i % 12) / 12
    waves = [f(j * angle) for j in (1, 2) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(months), i, *waves])


def test_many_series_with_waves(spark):
    """Against direct least squares; one key is NULL and is a series like any other."""
    keys = ["a", "b", None]
    values = {k: _seasonal(i, 30 + i) for i, k in enumerate(keys)}
    rows = [(k, _month(i), v) for k, vs in values.items() for i, v in enumerate(vs)]
    series = spark.createDataFrame(rows, "k string, ds date, y double")
    model = {r["k"]: r for r in forecast.fit_trend(series, ["k"], yearly=True).collect()}
    predicted = forecast.forecast(series, ["k"], yearly=True).orderBy("ds").collect()
    z = 1.2815515655446004
    for k, ys in values.items():
        n = len(ys)
        x = _design(n)
        coef, *_ = np.linalg.lstsq(x, np.array(ys), rcond=None)
        sigma = math.sqrt(((np.array(ys) - x @ coef) ** 2).sum() / (n - 6))
        assert model[k]["coef"] == pytest.approx(list(coef), rel=1e-6, abs=1e-4)
        assert model[k]["sigma"] == pytest.approx(sigma, rel=1e-6)
        full = _design(n + 6)
        leverage = np.einsum("ij,jk,ik->i", full, np.linalg.inv(x.T @ x), full)
        reach = z * sigma * np.sqrt(1 + leverage)
        mine = [r for r in predicted if r["k"] == k]
        assert [r["yhat"] for r in mine] == pytest.approx(list(full @ coef), rel=1e-6)
        assert [r["yhat_upper"] - r["yhat"] for r in mine] == pytest.approx(list(reach), rel=1e-6)


def test_too_short_for_waves(spark):
    series = _series(spark, [3.0, 4.0, 6.0])
    model = forecast.fit_trend(series, yearly=True).first()
    assert model["sigma"] is None and all(math.isfinite(c) for c in model["coef"])
    predicted = forecast.forecast(series, yearly=True).orderBy("ds").collect()
    assert [r["yhat"] for r in predicted[:3]] == pytest.approx([3, 4, 6], abs=1e-6)
    assert predicted[0]["yhat_lower"] is None


def test_monthly_revenue(spark):
    def order(i, status, day):
        return (i, f"c{i}", status, dt.datetime(*day), None, None, None, None)

    orders = spark.createDataFrame(
        [
            order("1", "delivered", (2020, 1, 1)),
            order("2", "delivered", (2020, 1, 31, 23, 59, 59)),
            order("3", "shipped", (2020, 1, 5)),
            order("4", "delivered", (2020, 3, 1)),
        ],
        COMMERCE["orders"],
    )
    items = spark.createDataFrame(
        [("1", "p", "s", 0.1, 1.0)] * 3
        + [("2", "q", "s", 0.2, 1.0), ("3", "p", "s", 50.0, 1.0), ("4", "p", "s", None, 1.0)],
        COMMERCE["order_items"],
    )
    jan, mar = dt.date(2020, 1, 1), dt.date(2020, 3, 1)
    total = {tuple(r) for r in forecast.monthly_revenue(items, orders).collect()}
    assert total == {(jan, 0.5), (mar, None)}
    every = {tuple(r) for r in forecast.monthly_revenue(items, orders, status=None).collect()}
    assert every == {(jan, 50.5), (mar, None)}
    freight = forecast.monthly_revenue(items, orders, measure="freight_value").collect()
    assert {tuple(r) for r in freight} == {(jan, 4.0), (mar, 1.0)}
    keyed = forecast.monthly_revenue(items, orders, keys=["product_id"]).collect()
    assert {tuple(r) for r in keyed} == {("p", jan, 0.3), ("q", jan, 0.2), ("p", mar, None)}


def test_export(spark, shipped_months):
    predicted = forecast.forecast(shipped_months)
    forecast.export_forecast(predicted.where("false"), "sales_forecast")
    stored = forecast.export_forecast(predicted, "sales_forecast")
    assert stored.columns == ["ds", "yhat", "yhat_lower", "yhat_upper"]
    assert sorted(r["ds"] for r in stored.collect())[-1] == "2019-02"
    assert spark.table("sales_forecast").count() == 26
    spark.sql("DROP TABLE sales_forecast")


def test_waves_follow_the_calendar(spark):
    """A series that starts in May has the same waves as one that starts in January."""
    values = _seasonal(1, 48)
    whole = _series(spark, values)
    late = whole.where(F.col("ds") >= dt.date(2017, 5, 1))
    a = forecast.fit_trend(whole, yearly=True).first()["coef"]
    b = forecast.fit_trend(late, yearly=True).first()["coef"]
    assert b[2:4] == pytest.approx(a[2:4], abs=60)


@pytest.mark.parametrize("yearly", [False, True])
def test_noise_on_a_high_level(spark, yearly):
    """What the model leaves unexplained does not drown in the size of the values."""
    noise = np.random.default_rng(7).normal(size=48).round(3)
    months = [dt.date(2019 + i // 12, i % 12 + 1, 1) for i in range(48)]
    sigmas = []
    for level in (0.0, 1e12):
        rows = [(m, level + 3.0 * i + float(e)) for i, (m, e) in enumerate(zip(months, noise))]
        series = spark.createDataFrame(rows, "ds date, y double")
        sigmas.append(forecast.fit_trend(series, yearly=yearly).first()["sigma"])
    assert sigmas[0] > 0.5
    assert sigmas[1] == pytest.approx(sigmas[0], rel=1e-3)


def test_forecast_and_accuracy_take_one_shuffle(spark):
    rows = [(k, dt.date(2020, m, 1), float(m * k)) for k in range(5) for m in range(1, 9)]
    rows += [(9, dt.date(2020, 1, 1), None), (None, dt.date(2020, 1, 1), 1.0), (1, None, 5.0)]
    series = spark.createDataFrame(rows, "k int, ds date, y double")
    for df in (forecast.forecast(series, ["k"]), forecast.accuracy(series, ["k"])):
        plan = physical(df)
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_accuracy_is_the_score_of_the_forecast(spark):
    rows = [(k, dt.date(2020, m, 1), float((m * 7 + k) % 5)) for k in (1, 2) for m in range(1, 9)]
    rows += [(2, dt.date(2020, 9, 1), None), (3, dt.date(2020, 1, 1), 1.0)]
    series = spark.createDataFrame(rows, "k int, ds date, y double")
    joined = forecast.score(series, forecast.forecast(series, ["k"]), ["k"]).collect()
    assert sorted(map(tuple, forecast.accuracy(series, ["k"]).collect())) == sorted(map(tuple, joined))
