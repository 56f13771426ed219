"""Error by horizon, change points and simulated bounds against plain refits and dense solves."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from plans import physical
from pyspark.sql import functions as F

from cartsight.operators import outlook

ROWS = "k string, ds date, y double"


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def frame(spark, series):
    """series: {key: {month number: y}}."""
    rows = [(k, month(i), y) for k, points in series.items() for i, y in points.items()]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def noisy(seed, n, slope=3.0, noise=5.0, gaps=0.0, start=0):
    rng = np.random.default_rng(seed)
    return {start + i: float(100 + slope * i + noise * rng.normal()) for i in range(n) if rng.random() >= gaps}


# --- rolling origin ----------------------------------------------------------------------------


def refits(points, horizon, least):
    """{horizon: (n, mae, mape)} with a new fit at each origin."""
    found = {}
    months = sorted(m for m, y in points.items() if y is not None)
    for origin in months:
        past = [m for m in months if m <= origin]
        if len(past) < max(2, least):
            continue
        slope, intercept = np.polyfit(past, [points[m] for m in past], 1)
        for h in range(1, horizon + 1):
            if points.get(origin + h) is not None:
                seen = points[origin + h]
                error = abs(seen - intercept - slope * (origin + h))
                found.setdefault(h, []).append((error, error / max(abs(seen), 2.0**-52)))
    return {h: (len(e), float(np.mean([x for x, _ in e])), 100 * float(np.mean([x for _, x in e]))) for h, e in found.items()}


def test_rolling_origin_is_a_refit_at_each_origin(spark):
    series = {"a": noisy(1, 40), "b": noisy(2, 60, gaps=0.3, start=7), "c": noisy(3, 11), "d": {0: 1.0}, None: noisy(4, 30)}
    series["e"] = {**noisy(5, 30), 12: None, 13: 0.0}
    found = outlook.rolling_origin(frame(spark, series), ["k"], horizon=5, least=8).collect()
    expected = {(k, h): v for k, points in series.items() for h, v in refits(points, 5, 8).items()}
    assert {(r.k, r.horizon): r.n for r in found} == {k: v[0] for k, v in expected.items()}
    for r in found:
        assert (r.mae, r.mape) == pytest.approx(expected[r.k, r.horizon][1:], rel=1e-7)


def test_rolling_origin_of_one_series_and_of_none(spark):
    points = noisy(6, 25)
    df = frame(spark, {"a": points}).drop("k")
    expected = refits(points, 6, 12)
    for r in outlook.rolling_origin(df).collect():
        assert (r.n, r.mae, r.mape) == pytest.approx(expected[r.horizon], rel=1e-7)
    assert outlook.rolling_origin(df.where("false")).collect() == []


def test_rolling_origin_takes_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "series")
    frame(spark, {"a": noisy(1, 40)}).write.parquet(path)
    plan = physical(outlook.rolling_origin(spark.read.schema(ROWS).parquet(path), ["k"]))
    assert plan.count("Exchange") == 1


# --- change points -----------------------------------------------------------------------------


def dense(points, changes, reach, strengths):
    """(strength, freedom, sigma, fitted function) by solving each penalised system as it stands."""
    months = np.array(sorted(points), float)
    y = np.array([points[int(m)] for m in months])
    first, span = months.min(), max(1.0, months.max() - months.min())
    kinks = np.array([reach * j / changes for j in range(1, changes + 1)])

    def features(m):
        x = (np.asarray(m, float) - first) / span
        return np.column_stack([np.ones_like(x), x, np.maximum(x[:, None] - kinks, 0)])

    a, n, best = features(months), len(y), None
    for strength in strengths:
        held = a.T @ a + n * strength * np.diag([0, 0] + [1] * changes)
        coef = np.linalg.solve(held, a.T @ (y - y.mean()))
        rss = float(np.sum((y - y.mean() - a @ coef) ** 2))
        freedom = n - float(np.trace(np.linalg.solve(held, a.T @ a)))
        error = n * rss / freedom**2
        if best is None or error <= best[0]:
            best = (error, strength, freedom, math.sqrt(rss / freedom), coef, np.linalg.inv(held))
    _, strength, freedom, sigma, coef, inverse = best
    return strength, freedom, sigma, lambda m: (
        y.mean() + features(m) @ coef,
        sigma * np.sqrt(1 + np.einsum("ri,ij,rj->r", features(m), inverse, features(m))),
    )


def kinked(seed, n, at, noise=1.0):
    rng = np.random.default_rng(seed)
    return {i: float(10 + 2 * i + 9 * max(0, i - at) + noise * rng.normal()) for i in range(n)}


@pytest.mark.parametrize("changes", [1, 4, 12])
def test_changes_equal_a_dense_solve(spark, changes):
    series = {"a": kinked(1, 40, 17), "b": noisy(2, 80, gaps=0.2, start=30), "c": noisy(3, 20), None: kinked(4, 25, 9, 20.0)}
    df = frame(spark, series)
    models = {r.k: r for r in outlook.fit_changes(df, ["k"], changes).collect()}
    drawn = {}
    for r in outlook.forecast_changes(df, ["k"], changes=changes).collect():
        drawn.setdefault(r.k, {})[(r.ds.year - 2000) * 12 + r.ds.month - 1] = r
    for k, points in series.items():
        strength, freedom, sigma, predict = dense(points, changes, 0.8, outlook.STRENGTHS)
        assert (models[k].n, models[k].strength) == (len(points), strength)
        assert (models[k].freedom, models[k].sigma) == pytest.approx((freedom, sigma), rel=1e-6)
        months = list(range(min(points), max(points) + 7))
        assert sorted(drawn[k]) == months
        yhat, reach = predict(months)
        assert [drawn[k][m].yhat for m in months] == pytest.approx(yhat.tolist(), rel=1e-6)
        up = [(drawn[k][m].yhat_upper - drawn[k][m].yhat) / 1.2815515655446004 for m in months]
        assert up == pytest.approx(reach.tolist(), rel=1e-6)


@pytest.mark.parametrize("at", [8, 13, 17])
def test_a_planted_kink_is_found_within_a_month(spark, at):
    points = kinked(at, 30, at, noise=0.5)
    model = outlook.fit_changes(frame(spark, {"a": points}), ["k"]).first()
    # A kink between two places is shared by them, so look at where half of the change has happened.
    bends = np.cumsum(model.coef[2:]) / sum(model.coef[2:])
    place = 0.8 * (1 + int(np.argmax(bends >= 0.5))) / 25 * model.span
    assert abs(place - at) <= 1


def test_a_straight_series_stays_straight(spark):
    model = outlook.fit_changes(frame(spark, {"a": noisy(1, 60, noise=20.0)}), ["k"]).first()
    assert model.freedom > 57  # of 58: the hinges take half a coefficient


def test_the_bounds_widen_after_the_last_month(spark):
    rows = sorted(outlook.forecast_changes(frame(spark, {"a": kinked(1, 40, 17)}), ["k"]).collect(), key=lambda r: r.ds)
    width = [r.yhat_upper - r.yhat_lower for r in rows[-7:]]
    assert width == sorted(width) and width[-1] > 1.02 * width[0]


def test_changes_of_short_series(spark):
    series = {"one": {5: 1.0}, "two": {5: 1.0, 9: 2.0}, "three": {0: 1.0, 1: 2.0, 2: 4.0}, "none": {1: None, 2: None}}
    df = frame(spark, series)
    assert [r.k for r in outlook.fit_changes(df, ["k"], 4).collect()] == ["three"]
    assert {r.k for r in outlook.forecast_changes(df, ["k"], changes=4).collect()} == {"three"}
    assert outlook.forecast_changes(df.where("false").drop("k")).collect() == []


# --- simulated bounds --------------------------------------------------------------------------


def test_simulated_bounds_cover_what_they_promise(spark):
    """80 % bounds on 1500 simulated series hold 77 to 83 % of the months that follow."""
    n, ahead = 36, 6
    series = {str(k): noisy(k, n + ahead) for k in range(1500)}
    past = {k: {m: y for m, y in p.items() if m < n} for k, p in series.items()}
    found = outlook.simulated_forecast(frame(spark, past), ["k"], periods=ahead, draws=100).collect()
    assert len(found) == 1500 * ahead
    inside = [r.yhat_lower <= series[r.k][(r.ds.year - 2000) * 12 + r.ds.month - 1] <= r.yhat_upper for r in found]
    assert abs(sum(inside) / len(inside) - 0.8) < 0.03


def test_simulation_is_the_same_in_any_partitioning(spark):
    df = frame(spark, {"a": noisy(1, 30), "b": noisy(2, 12, gaps=0.2), None: noisy(3, 20), "two": {1: 1.0, 2: 2.0}, "one": {1: 1.0}})
    runs = [
        sorted(map(str, outlook.simulated_forecast(df.repartition(p), ["k"], draws=50).collect())) for p in (1, 7)
    ]
    assert runs[0] == runs[1]
    other = sorted(map(str, outlook.simulated_forecast(df, ["k"], draws=50, seed=2).collect()))
    assert other != runs[0]
    two = [r for r in outlook.simulated_forecast(df, ["k"], draws=50).collect() if r.k == "two"]
    assert len(two) == 6 and all(r.yhat is not None and r.yhat_lower is None for r in two)
    alone = outlook.simulated_forecast(df.where("k = 'a'").drop("k"), draws=50)
    assert alone.where(F.col("yhat_lower") < F.col("yhat")).count() == 6
