"""Monthly revenue, forecast for many series at once.

A series is a set of rows (keys..., ds, y) with one row per month; ``keys`` may be empty, which
gives the single series of the whole shop. Every step is a grouping or a join on the keys, so the
number of series is free. The facts behind a series are added up once; store the result (see
``sources.stored``) before several steps read it.

Two models: a straight line, and a line plus yearly waves. Both are least squares with normal
bounds, in months since the first month of the series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.functions import joined_limbs, limb_sums, merged_limbs, month_index
from cartsight.operators.joins import join_facts
from cartsight.sources import materialise

# Smallest divisor of a relative error: the distance from 1.0 to the next double.
_EPSILON = 2.220446049250313e-16
# What a prediction needs of a model.
_PARAMETERS = ["first_month", "sigma", "coef", "spread"]
# Directions of a normal matrix weaker than this, relative to the strongest, carry no information.
_RANK_CUTOFF = 1e-10


# --- building series ---------------------------------------------------------------------------


def monthly_revenue(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame | None = None,
    products: DataFrame | None = None,
    keys: Sequence[str] = (),
    measure: str = "price",
    time: str = "order_purchase_timestamp",
    status: str | None = "delivered",
) -> DataFrame:
    """Add up ``measure`` of the items per series and month of ``time``; orders without one drop out.

    ``keys`` may name columns of the items, orders, customers and products. Months without sales
    have no row. Where the keys need no item column, items are added up per order first, which
    halves the join and takes the weight out of an order with very many items.
    """
    if status is not None:
        orders = orders.where(F.col("order_status") == status)
    orders = orders.where(F.col(time).isNotNull())
    if customers is not None:
        orders = join_facts(orders, customers, "customer_id")
    if products is None and not set(keys) & set(items.columns):
        sales = items.groupBy("order_id").agg(*limb_sums(measure, "amount"))
        total = merged_limbs("amount")
    else:
        sales, total = items, limb_sums(measure, "amount")
    sales = join_facts(sales, orders, "order_id")
    if products is not None:
        sales = sales.join(products, "product_id")
    return sales.groupBy(*keys, F.trunc(time, "month").alias("ds")).agg(
        joined_limbs(total).cast("double").alias("y")
    )


def to_series(monthly: DataFrame, month: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Turn a 'YYYY-MM' text column and a value column into (keys..., ds, y)."""
    return monthly.select(
        *keys, F.to_date(F.col(month), "yyyy-MM").alias("ds"), F.col(value).alias("y")
    ).where("ds IS NOT NULL")


def fill_months(series: DataFrame, keys: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Give every month between two rows of a series a row with ``fill``."""
    following = F.lead("ds").over(Window.partitionBy(*keys).orderBy("ds"))
    end = F.coalesce(F.add_months("until", -1), F.col("ds"))
    months = F.explode(F.sequence("ds", end, F.expr("interval 1 month")))
    value = F.when(F.col("ds") == F.col("known"), F.col("y")).otherwise(fill)
    return (
        series.withColumn("until", following)
        .select(*keys, F.col("ds").alias("known"), "y", months.alias("ds"))
        .select(*keys, "ds", value.alias("y"))
    )


def extend_months(series: DataFrame, keys: Sequence[str] = (), periods: int = 6) -> DataFrame:
    """The months of every series followed by the next ``periods`` months (keys..., ds)."""
    series = series.where(F.col("ds").isNotNull())
    last = series.groupBy(*keys).agg(F.max("ds").alias("last"))
    coming = F.sequence(
        F.add_months("last", 1), F.add_months("last", periods), F.expr("interval 1 month")
    )
    return series.select(*keys, "ds").unionByName(last.select(*keys, F.explode(coming).alias("ds")))


# --- fitting -----------------------------------------------------------------------------------


def fit_trend(
    series: DataFrame, keys: Sequence[str] = (), yearly: bool = False, order: int = 2
) -> DataFrame:
    """One model row per series: a line, or with ``yearly`` a line and ``order`` yearly waves.

    Both kinds carry n, the first month, sigma, the coefficients (``coef``) and the inverse of the
    normal matrix (``spread``), which :func:`predict` needs; the line also shows its slope and
    intercept. ``sigma`` is NULL where a series has no more points than coefficients, and a single
    point gives no line at all.
    """
    points = _without_level(series.where(F.col("y").isNotNull()), list(keys))
    if yearly:
        return _fit_yearly(points, list(keys), order)
    return _fit_line(points, list(keys))


def _without_level(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., ds, seen, level, y): ``y`` as it was seen, and without the mean of its series.

    Sums of squares of large values would drown what a model leaves unexplained. The window here
    and the sums of the fit share one shuffle.
    """
    level = F.avg("y").over(Window.partitionBy(*keys))
    return (
        series.where(F.col("ds").isNotNull())
        .select(*keys, "ds", F.col("y").alias("seen"), level.alias("level"))
        .withColumn("y", F.col("seen") - F.col("level"))
    )


def _fit_line(series: DataFrame, keys: list[str], history: bool = False) -> DataFrame:
    """The line of each series; with ``history`` also its months and what was seen (ds, y), a list
    as long as the calendar. Months without a value are in the list but not in the fit."""
    known = F.when(F.col("y").isNotNull(), month_index("ds"))
    points = series.select(*keys, "ds", "seen", "y", "level", known.alias("month"))
    y, month = F.col("y"), F.col("month")
    months = F.collect_list(F.struct("ds", F.col("seen").alias("y"))).alias("history")
    sums = points.groupBy(*keys).agg(
        F.count("y").alias("n"),
        F.first("level").alias("level"),
        F.min("month").alias("first_month"),
        F.regr_avgx(y, month).alias("mean_month"),
        F.regr_avgy(y, month).alias("mean_y"),
        F.regr_sxx(y, month).alias("sxx"),
        F.regr_sxy(y, month).alias("sxy"),
        F.regr_syy(y, month).alias("syy"),
        *([months] if history else []),
    )
    n, sxx, sxy, slope = F.col("n"), F.col("sxx"), F.col("sxy"), F.col("slope")
    centre = F.col("mean_month") - F.col("first_month")
    unexplained = F.greatest(F.lit(0.0), F.col("syy") - slope * sxy)
    # A single point has sxx = 0, and so a NULL slope; a line needs two months.
    fitted = (
        sums.where(n > 0)
        .withColumn("slope", F.try_divide(sxy, F.when(sxx > 0, sxx)))
        .withColumn("intercept", F.col("level") + F.col("mean_y") - slope * centre)
        .withColumn("sigma", F.when(n > 2, F.sqrt(F.try_divide(unexplained, n - 2))))
    )
    across = -F.try_divide(centre, sxx)
    return fitted.select(
        *keys,
        "n",
        "first_month",
        "slope",
        "intercept",
        "sigma",
        F.array("intercept", "slope").alias("coef"),
        F.array(
            F.try_divide(F.lit(1.0), n) + F.try_divide(centre * centre, sxx),
            across,
            across,
            F.try_divide(F.lit(1.0), sxx),
        ).alias("spread"),
        *(["history"] if history else []),
    )


def _waves(day: str | Column, order: int) -> list[Column]:
    angle = (F.month(day) - 1) * (2 * math.pi / 12)
    return [wave(angle * j) for j in range(1, order + 1) for wave in (F.sin, F.cos)]


def _fit_yearly(series: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Spark adds up the normal equations; Python solves one small system per series.

    The sums use months since a fixed date, so one pass suffices; the solver moves them to the
    first month of the series, which keeps the systems well conditioned.
    """
    size = 2 + 2 * order
    names = [f"f{i}" for i in range(size)]
    features = [F.lit(1.0), F.col("month").cast("double"), *_waves("ds", order)]
    points = (
        series.withColumn("month", month_index("ds"))
        .select(*keys, "y", "level", "month", *[f.alias(n) for f, n in zip(features, names)])
    )
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = points.groupBy(*keys).agg(
        F.count("y").alias("n"),
        F.first("level").alias("level"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a_{i}_{j}") for i, j in upper],
        *[F.sum(F.col(names[i]) * F.col("y")).alias(f"b_{i}") for i in range(size)],
        F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
    model = T.StructType(
        [sums.schema[k] for k in keys]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("first_month", T.IntegerType()),
            T.StructField("sigma", T.DoubleType()),
            T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("spread", T.ArrayType(T.DoubleType())),
        ]
    )

    return sums.where(F.col("n") > 0).mapInPandas(_solver(keys, size), model)


def _solver(
    keys: list[str], size: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Solve the normal equations, one row per series, an Arrow batch at a time.

    A series too short for all coefficients gets the smallest ones that fit it best. The function
    carries all it needs, so that executors need numpy and pandas but not this package.
    """
    cutoff = _RANK_CUTOFF

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sums in batches:
            rows = len(sums)
            gram = np.empty((rows, size, size))
            for i in range(size):
                for j in range(i, size):
                    gram[:, i, j] = gram[:, j, i] = sums[f"a_{i}_{j}"]
            moment = np.stack([sums[f"b_{i}"].to_numpy() for i in range(size)], axis=1)

            # month -> (month - first) / span, written as a change of basis
            first = sums["first_month"].to_numpy(dtype=float)
            span = np.maximum(1.0, sums["last_month"].to_numpy(dtype=float) - first)
            basis = np.tile(np.eye(size), (rows, 1, 1))
            basis[:, 1, 0] = -first / span
            basis[:, 1, 1] = 1.0 / span
            gram = basis @ gram @ basis.transpose(0, 2, 1)
            moment = np.einsum("rij,rj->ri", basis, moment)

            inverse = np.linalg.pinv(gram, rcond=cutoff, hermitian=True)
            coef = np.einsum("rij,rj->ri", inverse, moment)
            unexplained = (
                sums["yy"].to_numpy()
                - 2 * np.einsum("ri,ri->r", coef, moment)
                + np.einsum("ri,rij,rj->r", coef, gram, coef)
            )
            free = sums["n"].to_numpy(dtype=float) - size
            sigma = np.sqrt(np.maximum(0.0, unexplained) / np.where(free > 0, free, np.nan))

            per_month = np.ones((rows, size))
            per_month[:, 1] = 1.0 / span
            spread = inverse * per_month[:, :, None] * per_month[:, None, :]

            out = sums[[*keys, "n", "first_month"]].copy()
            out["sigma"] = pd.Series(sigma, index=sums.index).astype(object).where(free > 0, None)
            coef = coef * per_month
            coef[:, 0] += sums["level"].to_numpy()
            out["coef"] = list(coef)
            out["spread"] = list(spread.reshape(rows, size * size))
            yield out

    return solve


# --- predicting and scoring --------------------------------------------------------------------


def predict(
    model: DataFrame,
    axis: DataFrame,
    keys: Sequence[str] = (),
    level: float = 0.80,
    order: int = 0,
) -> DataFrame:
    """(keys..., ds, yhat, yhat_lower, yhat_upper) for the months in ``axis``.

    ``order`` is the number of yearly waves the model was fitted with, 0 for the line. The bounds
    hold ``level`` of the probability of a new observation; they are NULL where sigma is.
    """
    rows = axis.select(*keys, "ds")
    if keys:
        rows = _join_series(rows, model.select(*keys, *_PARAMETERS), keys)
    else:
        # One series has one model row, which every month reads as a scalar.
        only = model.select(F.struct(*_PARAMETERS)).scalar()
        rows = rows.withColumn("model", only).select("ds", "model.*")
    return _with_bounds(rows, [*keys, "ds"], level, order)


def _with_bounds(rows: DataFrame, kept: Sequence[str], level: float, order: int) -> DataFrame:
    """The columns ``kept`` with prediction and bounds; ``rows`` hold ``ds`` and a model each."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    months = (month_index("ds") - F.col("first_month")).cast("double")
    features = [F.lit(1.0), months, *_waves("ds", order)]
    size = len(features)
    coef, spread = F.col("coef"), F.col("spread")
    point = sum((coef[i] * features[i] for i in range(1, size)), coef[0])
    leverage = sum(
        spread[i * size + j] * features[i] * features[j] * (1 if i == j else 2)
        for i in range(size)
        for j in range(i, size)
    )
    rows = rows.select(
        *kept,
        point.alias("yhat"),
        (F.lit(z) * F.col("sigma") * F.sqrt(1 + leverage)).alias("reach"),
    )
    return rows.select(
        *kept,
        "yhat",
        (F.col("yhat") - F.col("reach")).alias("yhat_lower"),
        (F.col("yhat") + F.col("reach")).alias("yhat_upper"),
    )


def _join_series(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on the series keys, where NULL is a key value like any other."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in on]
    return left.join(renamed, same).drop(*[f"right_{k}" for k in on])


def forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    periods: int = 6,
    level: float = 0.80,
    yearly: bool = False,
    order: int = 2,
    fill: float | None = None,
) -> DataFrame:
    """Fit, extend and predict in one call: history and the next ``periods`` months.

    Months without a row take no part in the fit, unless ``fill`` gives them a value. The line takes
    one shuffle: its model carries the months of the series, which are predicted where it is. A
    series without any value has no model and no forecast.
    """
    if fill is not None:
        series = fill_months(series, keys, fill)
    if yearly:
        model = fit_trend(series, keys, yearly=True, order=order)
        return predict(model, extend_months(series, keys, periods), keys, level, order)
    model = _fit_line(_without_level(series, list(keys)), list(keys), history=True)
    last = F.array_max("history.ds")
    coming = F.sequence(
        F.add_months(last, 1), F.add_months(last, periods), F.expr("interval 1 month")
    )
    months = F.explode(F.concat("history.ds", coming)).alias("ds")
    return _with_bounds(model.select(*keys, *_PARAMETERS, months), [*keys, "ds"], level, 0)


def accuracy(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """:func:`score` of the line against the months it was fitted to, in the shuffle of the fit."""
    model = _fit_line(_without_level(series, list(keys)), list(keys), history=True)
    rows = model.select(*keys, *_PARAMETERS, F.explode("history").alias("month"))
    rows = rows.select(*keys, *_PARAMETERS, "month.ds", "month.y")
    return _errors(_with_bounds(rows, [*keys, "y"], 0.8, 0), keys)


def score(actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error, and mean absolute percentage error, per series over shared months."""
    pairs = _join_series(
        actual.select(*keys, "ds", "y"), predicted.select(*keys, "ds", "yhat"), [*keys, "ds"]
    )
    return _errors(pairs, keys)


def _errors(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    error = F.abs(F.col("y") - F.col("yhat"))
    relative = error / F.greatest(F.abs(F.col("y")), F.lit(_EPSILON))
    return pairs.groupBy(*keys).agg(
        F.avg(error).alias("mae"), (100 * F.avg(relative)).alias("mape")
    )


def export_frame(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The table handed to reports: month as 'YYYY-MM' text and the three numbers."""
    month = F.date_format("ds", "yyyy-MM").alias("ds")
    return predicted.select(*keys, month, "yhat", "yhat_lower", "yhat_upper")


def export_forecast(predicted: DataFrame, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """Store :func:`export_frame` as a catalogue table, replacing an earlier one."""
    return materialise(export_frame(predicted, keys), table, mode="overwrite")
