"""Daily series, and lagged values that a forecaster could really have at its horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Season in days, the fewest flights of a series day, lags and rolling windows.
SEASON = 7
MIN_FLIGHTS_PER_DAY = 30
LAGS = (1, 2, 3, 7, 14, 28)
ROLLING = (7, 28)


def national_series(rows: DataFrame, *, date: str = "flight_date", label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(date).alias("date")).agg(
        F.count(F.lit(1)).alias("flights"), F.avg(label).alias("rate")
    )


def busiest(rows: DataFrame, key: str = "origin", n: int = 10) -> DataFrame:
    """The n biggest keys by rows, the smaller key first on a tie."""
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("flights"))
        .orderBy(F.col("flights").desc(), key)
        .limit(n)
    )


def busiest_series(
    rows: DataFrame,
    *,
    key: str = "origin",
    date: str = "flight_date",
    label: str = "label",
    top_n: int = 10,
    min_flights: int = MIN_FLIGHTS_PER_DAY,
) -> DataFrame:
    """One row per busy key and day with enough flights.

    The daily table is aggregated once. Its roll-up names the busy keys (``top_n`` rows, so
    the broadcast is bounded by the argument), and the semi join runs on aggregated rows.
    """
    daily = rows.groupBy(key, F.col(date).alias("date")).agg(
        F.count(F.lit(1)).alias("flights"), F.avg(label).alias("rate")
    )
    top = (
        daily.groupBy(key)
        .agg(F.sum("flights").alias("all_flights"))
        .orderBy(F.col("all_flights").desc(), key)
        .limit(top_n)
    )
    return daily.join(F.broadcast(top), key, "left_semi").where(F.col("flights") >= min_flights)


def worst_days(series: DataFrame, n: int = 10) -> DataFrame:
    return series.orderBy(F.col("rate").desc(), "date").limit(n)


def describe_series(series: DataFrame) -> DataFrame:
    return series.agg(
        F.count(F.lit(1)).alias("days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min("rate").alias("min_rate"),
        F.median("rate").alias("median_rate"),
        F.max("rate").alias("max_rate"),
    )


def weekday_profile(series: DataFrame) -> DataFrame:
    """Mean of the daily rates by weekday, Monday 0."""
    return series.groupBy(F.weekday("date").alias("day_of_week")).agg(
        F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("days")
    )


def lag_names(horizon: int, lags: Sequence[int] = LAGS, rolling: Sequence[int] = ROLLING) -> list[str]:
    if horizon < 1:
        raise ValueError(f"cannot forecast {horizon} days ahead: one day is the least")
    return [f"lag_{n}" for n in lags if n >= horizon] + [f"roll_mean_{w}" for w in rolling]


def add_lags(
    series: DataFrame,
    *,
    horizon: int,
    column: str = "rate",
    group: str | None = None,
    date: str = "date",
    lags: Sequence[int] = LAGS,
    rolling: Sequence[int] = ROLLING,
) -> DataFrame:
    """Lags of ``horizon`` or more, and rolling means that end ``horizon`` rows before.

    A lag counts rows of the series, not days. A series has one row per day, so a window
    group is bounded by the calendar. All columns share one sort.
    """
    lag_names(horizon, lags, rolling)  # refuses a horizon below one
    window = Window.partitionBy(group if group else F.lit(0)).orderBy(date)
    new = {f"lag_{n}": F.lag(column, n).over(window) for n in lags if n >= horizon}
    for size in rolling:
        frame = window.rowsBetween(-(horizon + size - 1), -horizon)
        full = F.count(column).over(frame) == size
        new[f"roll_mean_{size}"] = F.when(full, F.avg(column).over(frame))
    return series.withColumns(new)


def add_date_lags(
    series: DataFrame,
    *,
    horizon: int,
    column: str = "rate",
    group: str | None = None,
    date: str = "date",
    lags: Sequence[int] = LAGS,
) -> DataFrame:
    """As the lags of :func:`add_lags`, but by calendar day: a gap in the series gives null.

    A range frame of exactly one day holds at most the one row with that date.
    """
    lag_names(horizon, lags, ())
    day = F.datediff(date, F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy(group if group else F.lit(0)).orderBy(day)
    return series.withColumns(
        {f"lag_{n}": F.max(column).over(window.rangeBetween(-n, -n)) for n in lags if n >= horizon}
    )


def seasonal_scale(
    series: DataFrame, keys: Sequence[str] = (), *, column: str = "rate", date: str = "date", season: int = SEASON
) -> DataFrame:
    """Mean absolute change over one season, per key. Null when there is nothing to compare."""
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(date)
    change = F.col(column) - F.lag(column, season).over(window)
    return series.withColumn("_change", F.abs(change)).groupBy(*keys).agg(F.avg("_change").alias("scale"))


def check_scale(scale: DataFrame) -> None:
    """Refuse a series for which MASE is undefined: shorter than a season, or flat."""
    bad = scale.where(F.col("scale").isNull() | (F.col("scale") == 0)).limit(1).count()
    if bad or scale.limit(1).count() == 0:
        raise ValueError("no seasonal change to scale by: series too short or flat")


def forecast_scores(predictions: DataFrame, scale: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MASE and n per keys and forecaster.

    ``predictions`` is long: keys, forecaster, actual, predicted. ``scale`` has one row per
    keys, or is a single row. MASE is null where the scale is zero: a flat series has none.
    """
    error = F.col("actual") - F.col("predicted")
    scored = predictions.groupBy(*keys, "forecaster").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )
    if keys:
        scored = scored.join(scale, list(keys))
    else:
        scored = scored.withColumn("scale", scale.select("scale").scalar())
    return scored.withColumn("mase", F.try_divide("mae", "scale")).drop("scale")


def model_free_forecasts(lagged: DataFrame, *, horizon: int, column: str = "rate", keys: Sequence[str] = ()) -> DataFrame:
    """The forecasts that need no model, in long form: last known, last week, monthly mean."""
    names = {
        "naive": f"lag_{horizon}",
        "seasonal_naive": f"lag_{SEASON}",
        "rolling_mean": "roll_mean_28",
    }
    usable = {k: v for k, v in names.items() if v in lagged.columns}
    pairs = F.inline(
        F.array(
            *[F.struct(F.lit(k).alias("forecaster"), F.col(v).alias("predicted")) for k, v in usable.items()]
        )
    )
    return lagged.select(*keys, "date", F.col(column).alias("actual"), pairs)


def tall_curve(predictions: DataFrame) -> DataFrame:
    """Actual and forecast as (date, series, rate)."""
    return predictions.select("date", "actual", "predicted").unpivot(
        ["date"], ["actual", "predicted"], "series", "rate"
    )


def curve_error(predictions: DataFrame) -> DataFrame:
    """Typical and worst error of a forecast curve, and the worst day itself."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    return predictions.agg(
        F.median(error).alias("median_error"), F.max(error).alias("worst_error"), F.max("actual").alias("worst_day")
    )
