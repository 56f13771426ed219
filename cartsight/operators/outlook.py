"""How far a forecast can be trusted: error by horizon, change points, and simulated bounds.

Series are those of :mod:`cartsight.operators.forecast`: (keys..., ds, y), one row per month, each as
long as the calendar at most. Each takes one shuffle of the series by key; the simulation spreads
its lines, one row a series, once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.functions import month_index
from cartsight.operators.forecast import _EPSILON, _without_level

# Strengths of the penalty on a change of slope, for each point of the series, from weak to strong.
STRENGTHS = tuple(10.0**k for k in range(-6, 1))


# --- error outside the fit ---------------------------------------------------------------------


def rolling_origin(
    series: DataFrame, keys: Sequence[str] = (), horizon: int = 6, least: int = 12
) -> DataFrame:
    """(keys..., horizon, n, mae, mape): errors of the line at every origin, by months ahead.

    Each month with at least ``least`` points up to it is an origin: the line through these points
    predicts the next ``horizon`` months, as far as they are known. The sums behind the line run along
    the series, so an origin costs one update and not a fit.
    """
    per = Window.partitionBy(*keys)
    run = per.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = per.orderBy("month").rangeBetween(1, horizon)
    month = month_index("ds")
    points = _without_level(series.where(F.col("y").isNotNull()), list(keys)).select(
        *keys, "seen", "level", "y", month.alias("month"), (month - F.min(month).over(per)).cast("double").alias("t")
    )
    t, y = F.col("t"), F.col("y")
    sums = points.select(
        *keys,
        "month",
        "level",
        t,
        F.count("y").over(run).alias("n"),
        F.sum(t).over(run).alias("st"),
        F.sum(y).over(run).alias("sy"),
        F.sum(t * t).over(run).alias("stt"),
        F.sum(t * y).over(run).alias("sty"),
        F.collect_list(F.struct("month", "seen")).over(ahead).alias("coming"),
    )
    n, st, sy = F.col("n"), F.col("st"), F.col("sy")
    slope = F.try_divide(n * F.col("sty") - st * sy, n * F.col("stt") - st * st)
    lines = (
        sums.where((n >= least) & (n > 1))
        .withColumn("slope", slope)
        .withColumn("intercept", F.col("level") + (sy - F.col("slope") * st) / n)
        .select(*keys, "month", "t", "slope", "intercept", F.explode("coming").alias("next"))
    )
    steps = (F.col("next.month") - F.col("month")).alias("horizon")
    yhat = F.col("intercept") + F.col("slope") * (F.col("t") + F.col("horizon"))
    error = F.abs(F.col("seen") - F.col("yhat"))
    relative = error / F.greatest(F.abs("seen"), F.lit(_EPSILON))
    return (
        lines.select(*keys, "t", "slope", "intercept", steps, F.col("next.seen").alias("seen"))
        .withColumn("yhat", yhat)
        .groupBy(*keys, "horizon")
        .agg(F.count("seen").alias("n"), F.avg(error).alias("mae"), (100 * F.avg(relative)).alias("mape"))
    )


# --- change points -----------------------------------------------------------------------------


def _kinks(changes: int, reach: float) -> list[float]:
    """Where the slope may change, as shares of the span of a series."""
    return [reach * j / changes for j in range(1, changes + 1)]


def fit_changes(
    series: DataFrame,
    keys: Sequence[str] = (),
    changes: int = 25,
    reach: float = 0.8,
    strengths: Sequence[float] = STRENGTHS,
) -> DataFrame:
    """A trend per series whose slope may change at ``changes`` places in the first ``reach`` of it.

    The model has a hinge for each place. Changes of slope are held small by a ridge penalty, whose
    strength is chosen for each series by generalised cross-validation; the level and the first slope
    are free. Series with fewer than three points have no model.

    Columns: keys, n, first_month, last_month, span, strength, freedom (points less effective
    coefficients), sigma, coef (level, slope, changes; per span) and spread (the inverse of the penalised
    normal matrix). Spark adds up five sums for each place, from which all products of hinges
    follow; Python solves an Arrow batch of small systems at once.
    """
    kinks = _kinks(changes, reach)
    per = Window.partitionBy(*keys)
    month = month_index("ds")
    points = _without_level(series.where(F.col("y").isNotNull()), list(keys)).select(
        *keys, "level", "y", month.alias("month"), F.min(month).over(per).alias("first"), F.max(month).over(per).alias("last")
    )
    span = F.greatest(F.col("last") - F.col("first"), F.lit(1))
    points = points.withColumn("x", (F.col("month") - F.col("first")) / span)
    x, y = F.col("x"), F.col("y")
    sums = []
    for j, kink in enumerate([-1.0, *kinks]):
        beyond = x > kink
        for name, value in (("s0", F.lit(1.0)), ("s1", x), ("s2", x * x), ("y0", y), ("y1", x * y)):
            sums.append(F.sum(F.when(beyond, value).otherwise(0.0)).alias(f"{name}_{j}"))
    added = points.groupBy(*keys).agg(
        F.count("y").alias("n"),
        F.first("level").alias("level"),
        F.min("first").alias("first_month"),
        F.max("last").alias("last_month"),
        F.sum(y * y).alias("yy"),
        *sums,
    )
    model = T.StructType(
        [added.schema[k] for k in keys]
        + [T.StructField(c, T.LongType()) for c in ("n",)]
        + [T.StructField(c, T.IntegerType()) for c in ("first_month", "last_month", "span")]
        + [T.StructField(c, T.DoubleType()) for c in ("strength", "freedom", "sigma")]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("coef", "spread")]
    )
    return added.where("n > 2").mapInPandas(_solve_hinges(list(keys), kinks, list(strengths)), model)


def _solve_hinges(
    keys: list[str], kinks: list[float], strengths: list[float]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Solve all series of a batch for all strengths and keep the best strength of each."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sums in batches:
            rows, size = len(sums), len(kinks)
            at = np.array(kinks)
            s0, s1, s2, y0, y1 = (
                np.stack([sums[f"{name}_{j}"].to_numpy() for j in range(size + 1)], axis=1)
                for name in ("s0", "s1", "s2", "y0", "y1")
            )
            n = sums["n"].to_numpy(dtype=float)
            # free part: level and slope; hinges: products over the points beyond the later kink
            free = np.empty((rows, 2, 2))
            free[:, 0, 0], free[:, 1, 1] = s0[:, 0], s2[:, 0]
            free[:, 0, 1] = free[:, 1, 0] = s1[:, 0]
            across = np.stack([s1[:, 1:] - at * s0[:, 1:], s2[:, 1:] - at * s1[:, 1:]], axis=1)
            later = np.maximum.outer(np.arange(size), np.arange(size)) + 1
            hinges = s2[:, later] - (at[:, None] + at) * s1[:, later] + at[:, None] * at * s0[:, later]
            to_free = np.stack([y0[:, 0], y1[:, 0]], axis=1)
            to_hinges = y1[:, 1:] - at * y0[:, 1:]

            inverse = np.linalg.inv(free)
            carried = inverse @ across
            rest = hinges - across.transpose(0, 2, 1) @ carried
            moment = to_hinges - np.einsum("rfh,rf->rh", carried, to_free)
            left = sums["yy"].to_numpy() - np.einsum("rf,rfg,rg->r", to_free, inverse, to_free)
            values, vectors = np.linalg.eigh(rest)
            values = np.maximum(values, 0.0)
            turned = np.einsum("rhk,rh->rk", vectors, moment)

            penalty = n[:, None] * np.array(strengths)
            held = values[:, None, :] + penalty[:, :, None]
            unexplained = left[:, None] - np.sum(turned[:, None] ** 2 * (held + penalty[:, :, None]) / held**2, axis=2)
            unexplained = np.maximum(unexplained, 0.0)
            freedom = n[:, None] - 2 - np.sum(values[:, None] / held, axis=2)
            error = np.where(freedom > 1e-9, n[:, None] * unexplained / np.maximum(freedom, 1e-9) ** 2, np.inf)
            # of equal errors the strongest penalty, the last
            best = error.shape[1] - 1 - np.argmin(error[:, ::-1], axis=1)
            each = np.arange(rows)
            held, freedom, unexplained = held[each, best], freedom[each, best], unexplained[each, best]

            bent = np.einsum("rhk,rk->rh", vectors, turned / held)
            straight = np.einsum("rfg,rg->rf", inverse, to_free) - np.einsum("rfh,rh->rf", carried, bent)
            spread = np.empty((rows, size + 2, size + 2))
            inner = (vectors / held[:, None]) @ vectors.transpose(0, 2, 1)
            spread[:, 2:, 2:] = inner
            spread[:, :2, 2:] = -carried @ inner
            spread[:, 2:, :2] = spread[:, :2, 2:].transpose(0, 2, 1)
            spread[:, :2, :2] = inverse + carried @ inner @ carried.transpose(0, 2, 1)

            out = sums[[*keys, "n", "first_month", "last_month"]].copy()
            out["span"] = np.maximum(1, out["last_month"] - out["first_month"]).astype(np.int32)
            out["strength"] = np.array(strengths)[best]
            out["freedom"] = freedom
            known = freedom > 1e-9
            sigma = np.sqrt(unexplained / np.where(known, freedom, 1.0))
            out["sigma"] = pd.Series(sigma, index=sums.index).astype(object).where(known, None)
            straight[:, 0] += sums["level"].to_numpy()
            out["coef"] = list(np.concatenate([straight, bent], axis=1))
            out["spread"] = list(spread.reshape(rows, -1))
            yield out

    return solve


def forecast_changes(
    series: DataFrame,
    keys: Sequence[str] = (),
    periods: int = 6,
    level: float = 0.80,
    changes: int = 25,
    reach: float = 0.8,
    strengths: Sequence[float] = STRENGTHS,
) -> DataFrame:
    """(keys..., ds, yhat, yhat_lower, yhat_upper) of :func:`fit_changes`, for every month from the first
    of the series to ``periods`` after the last. The bounds hold ``level`` of the probability of a new
    observation and widen with the uncertainty of the last slope."""
    kinks = _kinks(changes, reach)
    model = fit_changes(series, keys, changes, reach, strengths)
    months = F.explode(F.sequence(F.lit(0), F.col("last_month") - F.col("first_month") + periods)).alias("ahead")
    x = F.col("ahead") / F.col("span")
    features = F.array(F.lit(1.0), x, *[F.greatest(x - kink, F.lit(0.0)) for kink in kinks])
    rows = model.select(*keys, "first_month", "span", "sigma", "coef", "spread", months).withColumn("features", features)
    size = len(kinks) + 2

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    along = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: dot(F.slice("spread", i * size + 1, F.lit(size)), F.col("features")),
    )
    reach_up = NormalDist().inv_cdf(0.5 + level / 2) * F.col("sigma") * F.sqrt(1 + dot(along, F.col("features")))
    day = F.add_months(F.lit("2000-01-01").cast("date"), F.col("first_month") + F.col("ahead"))
    drawn = rows.select(*keys, day.alias("ds"), dot(F.col("coef"), F.col("features")).alias("yhat"), reach_up.alias("up"))
    return drawn.select(
        *keys, "ds", "yhat", (F.col("yhat") - F.col("up")).alias("yhat_lower"), (F.col("yhat") + F.col("up")).alias("yhat_upper")
    )


# --- simulated bounds --------------------------------------------------------------------------


def _number(text: Column) -> Column:
    """32 bits of a hash, that other engines have as well."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def simulated_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    periods: int = 6,
    level: float = 0.80,
    draws: int = 200,
    seed: int = 1,
) -> DataFrame:
    """(keys..., ds, yhat, yhat_lower, yhat_upper) for the next ``periods`` months, by residual bootstrap.

    Each draw gives every month of the series one of the residuals of its line, draws the line through
    these anew, and adds a residual to what that line predicts; the bounds are quantiles over the draws.
    So they hold the uncertainty of the trend and the true shape of the noise. Which residual is taken is
    told by a hash of ``seed``, series, draw and month: results do not depend on partitions or runs.
    Residuals are widened by the two coefficients that the line takes up. Bounds are NULL for series of
    two months; a single month has no line.
    """
    total = lambda column: F.aggregate(column, F.lit(0.0), lambda s, v: s + v)
    offset = lambda day: (month_index(day) - F.col("first_month")).cast("double")
    dated = series.where(F.col("ds").isNotNull())
    point = F.when(F.col("y").isNotNull(), F.struct("ds", "y"))
    lines = dated.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"), F.max("ds").alias("last"))
    # All sums run along the sorted months, so they are the same to the last digit.
    lines = lines.withColumn("size", F.size("points")).where("size > 1")
    lines = lines.withColumn("first_month", month_index(F.col("points")[0].ds))
    lines = lines.withColumn("months", F.transform("points", lambda p: offset(p.ds)))
    lines = lines.withColumn("centre", total("months") / F.col("size"))
    lines = lines.withColumn("mean", total("points.y") / F.col("size"))
    lines = lines.withColumn("around", F.transform("months", lambda t: t - F.col("centre")))
    lines = lines.withColumn("sxx", total(F.transform("around", lambda t: t * t))).where("sxx > 0")
    above = F.zip_with("around", "points", lambda t, p: t * (p.y - F.col("mean")))
    lines = lines.withColumn("slope", total(above) / F.col("sxx"))
    lines = lines.withColumn("intercept", F.col("mean") - F.col("slope") * F.col("centre"))
    widened = F.sqrt(F.try_divide(F.col("size").cast("double"), F.col("size") - 2))
    fitted = lambda t: F.col("intercept") + F.col("slope") * t
    left = F.zip_with("points", "months", lambda p, t: (p.y - fitted(t)) * widened)
    lines = lines.withColumn("residuals", left)
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])

    def drawn(place: Column) -> Column:
        text = F.concat_ws("|", F.col("name"), F.col("draw").cast("string"), place.cast("string"))
        return F.get("residuals", F.pmod(_number(text), F.col("size")).cast("int"))

    picks = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: drawn(i))
    if keys:
        # Few bytes but much work: adaptive execution would put many series into one task.
        parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartition(parts, *keys)
    shifted = (
        lines.withColumn("name", name)
        .select(*keys, "slope", "intercept", "first_month", "last", "size", "centre", "around", "sxx", "residuals", "name", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        .withColumn("picks", picks)
        .withColumn("up", total(F.col("picks")) / F.col("size"))
        .withColumn("turn", total(F.zip_with("around", "picks", lambda t, r: t * r)) / F.col("sxx"))
        .select(*keys, "slope", "intercept", "first_month", "last", "size", "centre", "residuals", "name", "draw", "up", "turn", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
        .withColumn("ds", F.add_months("last", F.col("step")))
        .withColumn("t", offset("ds"))
        .withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("t"))
    )
    moved = F.col("up") + F.col("turn") * (F.col("t") - F.col("centre")) + drawn(F.col("size") + F.col("step") - 1)
    tail = (1 - level) / 2
    return (
        shifted.select(*keys, "ds", "yhat", (F.col("yhat") + moved).alias("seen"))
        .groupBy(*keys, "ds")
        .agg(
            F.min("yhat").alias("yhat"),
            F.percentile("seen", tail).alias("yhat_lower"),
            F.percentile("seen", 1 - tail).alias("yhat_upper"),
        )
    )
