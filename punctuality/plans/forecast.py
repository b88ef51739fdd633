"""Rolling-origin forecasts: boosted trees refitted per block, and a seasonal autoregression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.functions.calendar import CALENDAR_FEATURES
from punctuality.operators.boosting import Settings, fit_many
from punctuality.operators.series import (
    SEASON,
    add_lags,
    forecast_scores,
    lag_names,
    model_free_forecasts,
    seasonal_scale,
)
from punctuality.session import materialised

# Boosting rounds and learning rate of the regressor, and the horizons reported.
REGRESSOR_ROUNDS = 300
REGRESSOR_RATE = 0.05
HORIZONS = (1, 7)


#: Boosted trees on the squared loss.
REGRESSOR = Settings(loss="squared", rounds=REGRESSOR_ROUNDS, rate=REGRESSOR_RATE)


def month_blocks(frame: DataFrame, first_test_date: date) -> list[date]:
    """First days of the months that are forecast: one driver row per month."""
    months = (
        frame.where(F.col("date") >= F.lit(first_test_date))
        .select(F.trunc("date", "month").alias("block"))
        .distinct()
        .orderBy("block")
        .collect()
    )
    if not months:
        raise ValueError(f"nothing to forecast from {first_test_date} on")
    return [r["block"] for r in months]


@dataclass(frozen=True)
class Part:
    """A frame to be forecast month by month, ``horizon`` days ahead."""

    frame: DataFrame
    features: Sequence[str]
    horizon: int
    first_test_date: date
    gap: bool = True


def backtests(parts: Mapping[str, Part], settings: Settings = REGRESSOR) -> dict[str, DataFrame]:
    """Forecasts of all parts: for each month of each, a model of everything known before it.

    A training row is repeated for every month that it is known before; all models of all
    months and parts are then fitted side by side, without a loop over months.
    """
    every = list(dict.fromkeys(f for part in parts.values() for f in part.features))
    train, tests = None, {}
    for name, part in parts.items():
        work = materialised(part.frame.na.drop(subset=[*part.features, "rate"]), "backtest")
        # The first forecast of a block is made ``horizon`` days before it.
        lead = timedelta(days=part.horizon - 1 if part.gap else 0)
        blocks = month_blocks(work, part.first_test_date)
        ends = F.array(*[F.struct(F.lit(f"{name} {b:%Y-%m}").alias("fit"), F.lit(b - lead).alias("end")) for b in blocks])
        rows = work.select("*", F.inline(F.filter(ends, lambda x: F.col("date") < x["end"])))
        known = [(F.col(f) if f in part.features else F.lit(None)).cast("double").alias(f) for f in every]
        rows = rows.select("fit", "rate", *known)
        train = rows if train is None else train.unionByName(rows)
        fit = F.concat(F.lit(f"{name} "), F.date_format("date", "yyyy-MM"))
        test = work.where(F.col("date") >= F.lit(part.first_test_date))
        tests[name] = test.select(*work.columns, fit.alias("_fit"), *[F.lit(None).cast("double").alias(f) for f in every if f not in work.columns])
    model = fit_many(train, "fit", "rate", every, settings=settings)
    # Months before which nothing is known have no model and no forecast.
    return {
        name: test.withColumn("predicted", model.column(F.col("_fit"))).where(F.col("predicted").isNotNull()).select(*parts[name].frame.columns, "predicted")
        for name, test in tests.items()
    }


def rolling_origin_backtest(
    frame: DataFrame,
    features: Sequence[str],
    *,
    horizon: int,
    first_test_date: date,
    settings: Settings = REGRESSOR,
    gap: bool = True,
) -> DataFrame:
    """Fit on everything before each month, predict the month; all months together.

    With ``gap`` the training rows end where the first forecast of the block is made, so no
    target is used that was not known; without it they end the day before the block.
    """
    return backtests({"all": Part(frame, features, horizon, first_test_date, gap)}, settings)["all"]


def forecast_report(
    national: DataFrame,
    by_series: DataFrame,
    first_test_date: date,
    *,
    key: str = "origin",
    horizons: Sequence[int] = HORIZONS,
    settings: Settings = REGRESSOR,
) -> DataFrame:
    """Scores per series set, horizon and forecaster, each series on its own scale.

    Both frames carry the calendar features. The report of the single series has the
    seasonal autoregression too.
    """
    before = F.col("date") < F.lit(first_test_date)
    # One row per series and day, written once: the report reads them some twenty times.
    national, by_series = materialised(national, "national"), materialised(by_series, "by-series")
    sets = (("national", national, None), ("by series", by_series, key))
    parts = {}
    for name, frame, group in sets:
        for horizon in horizons:
            lagged = add_lags(frame, horizon=horizon, group=group)
            parts[f"{name} {horizon}"] = Part(lagged, [*CALENDAR_FEATURES, *lag_names(horizon)], horizon, first_test_date)
    forecasts = backtests(parts, settings)
    out = None
    for name, frame, group in sets:
        keys = [group] if group else []
        for horizon in horizons:
            part = parts[f"{name} {horizon}"]
            predictions = forecasts[f"{name} {horizon}"]
            history = frame if group else frame.join(
                part.frame.na.drop(subset=part.features).select("date"), "date", "left_semi"
            )
            scale = materialised(seasonal_scale(history.where(before), keys), "scale")
            predictions = materialised(predictions, "predictions")
            long = model_free_forecasts(predictions, horizon=horizon, keys=keys).unionByName(
                predictions.select(
                    *keys, "date", F.col("rate").alias("actual"), F.lit("gradient_boosting").alias("forecaster"), "predicted"
                )
            )
            if not group:
                auto = seasonal_autoregression(frame, horizon=horizon, first_test_date=first_test_date)
                long = long.unionByName(
                    auto.select("date", "actual", F.lit("seasonal_ar").alias("forecaster"), "predicted")
                )
            one = forecast_scores(long, scale, keys).select(
                F.lit(name).alias("series_set"),
                (F.col(group) if group else F.lit("all")).alias("series"),
                F.lit(horizon).alias("horizon"),
                "forecaster",
                "mae",
                "rmse",
                "mase",
                "n",
            )
            out = one if out is None else out.unionByName(one)
    return out


# Candidate orders as (lags, difference, seasonal lags, seasonal difference). They
# are the autoregressive parts of a small seasonal grid; moving-average terms are left out,
# because with them the fit is no longer a sum over rows.
ORDERS = ((1, 0, 1, 0), (2, 0, 1, 0), (1, 1, 1, 0), (1, 0, 0, 1), (2, 0, 0, 1), (1, 1, 0, 1))
_TERMS = 4


def _season_lag(horizon: int) -> int:
    """The shortest whole number of seasons that is known at the horizon."""
    return -(-horizon // SEASON) * SEASON


def _terms(horizon: int, order: tuple[int, int, int, int]) -> tuple[dict[int, int], list[dict[int, int]]]:
    """What is known of the target, and the regressors, as {lag: weight} over the series.

    Every lag is ``horizon`` or more, so the forecast of a day uses only days that were over
    when it was made, at exactly this lead.
    """
    p, d, sp, sd = order
    season = _season_lag(horizon)
    # The differenced series is a weighted sum of lags of the series itself.
    weights = {0: 1}
    for lag in ([horizon] if d else []) + ([season] if sd else []):
        for at, w in list(weights.items()):
            weights[at + lag] = weights.get(at + lag, 0) - w
    known = {lag: -w for lag, w in weights.items() if lag}
    starts = [horizon + i for i in range(p)] + [season + SEASON * i for i in range(1, sp + 1)]
    return known, [{start + lag: w for lag, w in weights.items()} for start in starts]


def _all_lags(horizon: int) -> list[int]:
    lags = set()
    for order in ORDERS:
        known, terms = _terms(horizon, order)
        lags |= set(known).union(*terms)
    return sorted(lags)


def _weighted(lags: dict[int, int]):
    total = F.lit(0.0)
    for lag, weight in sorted(lags.items()):
        total = total + weight * F.col(f"_l{lag}")
    return total


def design(series: DataFrame, *, horizon: int, group: str | None = None, column: str = "rate") -> DataFrame:
    """One row per day and candidate order: target ``z``, known part, regressors ``x``.

    Only days for which every lag of every candidate exists, so all candidates are fitted on
    the same days and their AIC values compare.
    """
    window = Window.partitionBy(group if group else F.lit(0)).orderBy("date")
    lags = _all_lags(horizon)
    lagged = series.withColumns({f"_l{n}": F.lag(column, n).over(window) for n in lags}).na.drop(
        subset=[column, *[f"_l{n}" for n in lags]]
    )
    rows = []
    for i, order in enumerate(ORDERS):
        known, terms = _terms(horizon, order)
        x = [F.lit(1.0), *[_weighted(t) for t in terms]]
        x += [F.lit(0.0)] * (_TERMS - len(x))
        rows.append(
            F.struct(
                F.lit(i).alias("order"),
                F.lit(len(terms) + 1).alias("parameters"),
                _weighted(known).alias("known"),
                (F.col(column) - _weighted(known)).alias("z"),
                F.array(*x).alias("x"),
            )
        )
    keys = [group] if group else []
    return lagged.select(*keys, "date", F.col(column).alias("actual"), F.inline(F.array(*rows)))


_FIT = T.StructType(
    [T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType())]
)


def _least_squares():
    """Least squares from the sums of products of a group: a few numbers per row.

    Self-contained, so that executors need nothing but numpy and pandas.
    """

    def solve(xx: pd.Series, xz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        betas, rss = [], []
        for a, b, c in zip(xx, xz, zz):
            b = np.asarray(b, dtype=float)
            # Unused terms are all zero; the least-norm solution leaves them at zero.
            beta = np.linalg.lstsq(np.asarray(a, dtype=float).reshape(len(b), len(b)), b, rcond=1e-12)[0]
            betas.append(beta.tolist())
            rss.append(max(float(c - beta @ b), 0.0))
        return pd.DataFrame({"coefficients": betas, "rss": rss})

    return F.pandas_udf(solve, _FIT)


def _products(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of products per keys: the whole of least squares that needs the rows."""
    x, z = F.col("x"), F.col("z")
    sums = [F.sum(x[i] * x[j]).alias(f"_xx{i}{j}") for i in range(_TERMS) for j in range(_TERMS)]
    sums += [F.sum(x[i] * z).alias(f"_xz{i}") for i in range(_TERMS)]
    return rows.groupBy(*keys).agg(
        *sums, F.sum(z * z).alias("_zz"), F.count(F.lit(1)).alias("_n"), F.first("parameters").alias("parameters")
    )


_SUMS = [f"_xx{i}{j}" for i in range(_TERMS) for j in range(_TERMS)] + [f"_xz{i}" for i in range(_TERMS)] + ["_zz", "_n"]


def _solved(products: DataFrame) -> DataFrame:
    xx = F.array(*[F.col(f"_xx{i}{j}") for i in range(_TERMS) for j in range(_TERMS)])
    xz = F.array(*[F.col(f"_xz{i}") for i in range(_TERMS)])
    return products.withColumn("_fit", _least_squares()(xx, xz, F.col("_zz"))).select(
        *[c for c in products.columns if c not in _SUMS], "_n", "_fit.coefficients", "_fit.rss"
    )


def order_scores(rows: DataFrame, first_test_date: date, keys: Sequence[str] = ()) -> DataFrame:
    """AIC of each candidate order on the days before the test, per series."""
    fitted = _solved(_products(rows.where(F.col("date") < F.lit(first_test_date)), [*keys, "order"]))
    n = F.col("_n")
    spread = F.greatest(F.col("rss") / n, F.lit(1e-300))
    return fitted.select(*keys, "order", (n * F.log(spread) + 2 * (F.col("parameters") + 1)).alias("aic"))


def seasonal_autoregression(
    series: DataFrame, *, horizon: int, first_test_date: date, group: str | None = None, column: str = "rate"
) -> DataFrame:
    """Forecasts of the test days at exactly ``horizon``, refitted before each month.

    All refits come from one aggregate: sums of products per month become, by a running sum
    over the months, the sums over everything known before each month. A day counts from the
    day on which a forecast could first have used it. No loop over series, orders or months.
    """
    keys = [group] if group else []
    # Written once: selection, refits and forecasts all read it. A few numbers per day.
    rows = materialised(design(series, horizon=horizon, group=group, column=column), "design")
    aic = order_scores(rows, first_test_date, keys)
    best = aic.groupBy(*keys).agg(F.min_by("order", F.struct("aic", "order")).alias("order"))
    usable_from = F.trunc(F.date_add("date", horizon - 1), "month")
    # Only the order that was chosen is refitted: one small row per series.
    if keys:
        chosen = rows.join(best, [*keys, "order"], "left_semi")
    else:
        chosen = rows.where(F.col("order") == best.select("order").scalar())
    test = chosen.where(F.col("date") >= F.lit(first_test_date)).withColumn("block", F.trunc("date", "month"))
    # Every block gets a row of its own, with zero sums where no training day falls on it.
    blocks = test.select(*keys, "order", F.col("block").alias("_month"), *[F.lit(0).alias(c) for c in _SUMS]).distinct()
    monthly = _products(chosen.withColumn("_month", usable_from), [*keys, "order", "_month"]).drop("parameters")
    by_month = monthly.unionByName(blocks).groupBy(*keys, "order", "_month").agg(*[F.sum(c).alias(c) for c in _SUMS])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    known = by_month.withColumns({c: F.sum(c).over(earlier) for c in _SUMS}).where(F.col("_n") > 0)
    fits = _solved(known.withColumnRenamed("_month", "block")).select(*keys, "order", "block", "coefficients")
    step = F.lit(0.0)
    for i in range(_TERMS):
        step = step + F.col("x")[i] * F.col("coefficients")[i]
    return test.join(fits, [*keys, "order", "block"]).select(
        *keys, "date", "order", "actual", (F.col("known") + step).alias("predicted")
    )
