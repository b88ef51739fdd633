"""Queries over daily series: calendar, lags, forecasts without a model, their scores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from punctuality.functions.calendar import add_calendar_features
from punctuality.operators import series
from punctuality.plans import inputs
from punctuality.registry.shared import comparable, with_ctes

_D = inputs.DAILY_SQL
#: About two and a half test rows make a series day, where the feed has hundreds.
TEST_MIN_FLIGHTS = 3
#: The last year of the test series is the one that is forecast.
FIRST_TEST_DATE = "2000-09-01"

NATIONAL_SQL = "national AS (SELECT flight_date AS date, count(*) AS flights, avg(label) AS rate FROM day_rows GROUP BY 1)"
BUSIEST_SQL = f"""
top AS (SELECT origin FROM day_rows GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT 5),
busy AS (SELECT origin, flight_date AS date, count(*) AS flights, avg(label) AS rate FROM day_rows
    WHERE origin IN (SELECT origin FROM top) GROUP BY 1, 2 HAVING count(*) >= {TEST_MIN_FLIGHTS})"""


def national(spark, sf_dir):
    return series.national_series(inputs.daily_rows(spark, sf_dir))


def busy(spark, sf_dir):
    return series.busiest_series(inputs.daily_rows(spark, sf_dir), top_n=5, min_flights=TEST_MIN_FLIGHTS)


# The same holidays written out year by year for SQL: first weekdays by arithmetic on dates.
HOLIDAYS_SQL = """
years AS (SELECT CAST(y AS INTEGER) AS y FROM (SELECT unnest(range(
    (SELECT min(year(date)) - 1 FROM dates), (SELECT max(year(date)) + 2 FROM dates))) AS y) u),
fixed AS (SELECT make_date(y, 1, 1) AS d FROM years UNION ALL SELECT make_date(y, 6, 19) FROM years WHERE y >= 2021
    UNION ALL SELECT make_date(y, 7, 4) FROM years UNION ALL SELECT make_date(y, 11, 11) FROM years
    UNION ALL SELECT make_date(y, 12, 25) FROM years),
observed AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS h FROM fixed),
moving AS (SELECT y, unnest([make_date(y, 1, 15), make_date(y, 2, 15), make_date(y, 5, 25), make_date(y, 9, 1),
    make_date(y, 10, 8), make_date(y, 11, 22)]) AS earliest FROM years),
floating AS (SELECT earliest + CAST((CASE WHEN month(earliest) = 11 THEN 4 ELSE 1 END + 7 - isodow(earliest)) % 7 AS INTEGER) AS h
    FROM moving),
holidays AS (SELECT h FROM observed UNION SELECT h FROM floating),
nearest AS (SELECT date, min_by(date_diff('day', h, date), abs(date_diff('day', h, date)) * 100000 + date_diff('day', DATE '1970-01-01', h)) AS off
    FROM (SELECT DISTINCT date FROM dates) JOIN holidays ON h BETWEEN date - 120 AND date + 120 GROUP BY 1)"""


def _calendar(spark, sf_dir):
    return comparable(add_calendar_features(national(spark, sf_dir)))


def _lagged(source, horizon, group):
    def run(spark, sf_dir):
        return comparable(series.add_lags(source(spark, sf_dir), horizon=horizon, group=group))

    part = f"PARTITION BY {group}" if group else ""
    lags = "".join(f", round(lag(rate, {n}) OVER w, 6) AS lag_{n}" for n in series.LAGS if n >= horizon)
    rolls = "".join(
        f""", round(CASE WHEN count(rate) OVER ({part} ORDER BY date ROWS BETWEEN {horizon + w - 1} PRECEDING AND {horizon} PRECEDING) = {w}
        THEN avg(rate) OVER ({part} ORDER BY date ROWS BETWEEN {horizon + w - 1} PRECEDING AND {horizon} PRECEDING) END, 6) AS roll_mean_{w}"""
        for w in series.ROLLING
    )
    table, ctes = ("busy", (_D, BUSIEST_SQL)) if group else ("national", (_D, NATIONAL_SQL))
    key = f"{group}, " if group else ""
    sql = with_ctes(
        f"""SELECT {key}strftime(date, '%Y-%m-%d') AS date, flights, round(rate, 6) AS rate{lags}{rolls}
        FROM {table} WINDOW w AS ({part} ORDER BY date)""",
        *ctes,
    )
    return run, sql


def _date_lags(spark, sf_dir):
    return comparable(series.add_date_lags(busy(spark, sf_dir), horizon=7, group="origin"))


_DATE_LAGS_SQL = with_ctes(
    """SELECT b.origin, strftime(b.date, '%Y-%m-%d') AS date, b.flights, round(b.rate, 6) AS rate,
    round(l7.rate, 6) AS lag_7, round(l14.rate, 6) AS lag_14, round(l28.rate, 6) AS lag_28 FROM busy b
    LEFT JOIN busy l7 ON l7.origin = b.origin AND l7.date = b.date - 7
    LEFT JOIN busy l14 ON l14.origin = b.origin AND l14.date = b.date - 14
    LEFT JOIN busy l28 ON l28.origin = b.origin AND l28.date = b.date - 28""",
    _D,
    BUSIEST_SQL,
)


def complete(lagged, horizon):
    return lagged.na.drop(subset=["rate", *series.lag_names(horizon)])


def _naive_scores(horizon):
    def run(spark, sf_dir):
        kept = complete(series.add_lags(national(spark, sf_dir), horizon=horizon), horizon)
        test_from = F.lit(date.fromisoformat(FIRST_TEST_DATE))
        scale = series.seasonal_scale(kept.where(F.col("date") < test_from))
        forecasts = series.model_free_forecasts(kept.where(F.col("date") >= test_from), horizon=horizon)
        return comparable(series.forecast_scores(forecasts, scale))

    lags = ", ".join(f"lag(rate, {n}) OVER w AS lag_{n}" for n in series.LAGS if n >= horizon)
    rolls = ", ".join(
        f"""CASE WHEN count(rate) OVER (ORDER BY date ROWS BETWEEN {horizon + w - 1} PRECEDING AND {horizon} PRECEDING) = {w}
        THEN avg(rate) OVER (ORDER BY date ROWS BETWEEN {horizon + w - 1} PRECEDING AND {horizon} PRECEDING) END AS roll_mean_{w}"""
        for w in series.ROLLING
    )
    # The longest lag is the last to become known.
    sql = with_ctes(
        """SELECT forecaster, round(avg(abs(actual - predicted)), 6) AS mae,
        round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, count(*) AS n,
        round(avg(abs(actual - predicted)) / (SELECT s FROM scale), 6) AS mase FROM long GROUP BY 1""",
        _D,
        NATIONAL_SQL,
        f"lagged AS (SELECT *, {lags}, {rolls} FROM national WINDOW w AS (ORDER BY date))",
        "kept AS (SELECT * FROM lagged WHERE lag_28 IS NOT NULL AND roll_mean_28 IS NOT NULL)",
        f"""scale AS (SELECT avg(abs(rate - prev)) AS s FROM (SELECT rate, lag(rate, 7) OVER (ORDER BY date) AS prev
            FROM kept WHERE date < DATE '{FIRST_TEST_DATE}') q)""",
        f"""long AS (SELECT 'naive' AS forecaster, rate AS actual, lag_{horizon} AS predicted FROM kept WHERE date >= DATE '{FIRST_TEST_DATE}'
            UNION ALL SELECT 'seasonal_naive', rate, lag_7 FROM kept WHERE date >= DATE '{FIRST_TEST_DATE}'
            UNION ALL SELECT 'rolling_mean', rate, roll_mean_28 FROM kept WHERE date >= DATE '{FIRST_TEST_DATE}')""",
    )
    return run, sql


def _series_mase(spark, sf_dir):
    rows = busy(spark, sf_dir)
    test_from = F.lit(date.fromisoformat(FIRST_TEST_DATE))
    scale = series.seasonal_scale(rows.where(F.col("date") < test_from), ["origin"])
    lagged = series.add_lags(rows, horizon=7, group="origin").where(F.col("date") >= test_from)
    forecasts = series.model_free_forecasts(lagged, horizon=7, keys=["origin"])
    return comparable(series.forecast_scores(forecasts, scale, ["origin"]))


_SERIES_MASE_SQL = with_ctes(
    f"""SELECT l.origin, forecaster, round(avg(abs(actual - predicted)), 6) AS mae,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, count(*) AS n,
    round(avg(abs(actual - predicted)) / nullif(any_value(s.s), 0), 6) AS mase FROM long l JOIN scale s ON s.origin = l.origin GROUP BY 1, 2""",
    _D,
    BUSIEST_SQL,
    """lagged AS (SELECT *, lag(rate, 7) OVER (PARTITION BY origin ORDER BY date) AS lag_7,
        CASE WHEN count(rate) OVER (PARTITION BY origin ORDER BY date ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING) = 28 THEN
        avg(rate) OVER (PARTITION BY origin ORDER BY date ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING) END AS roll FROM busy)""",
    f"""scale AS (SELECT origin, avg(abs(rate - prev)) AS s FROM (SELECT origin, rate, lag(rate, 7) OVER
        (PARTITION BY origin ORDER BY date) AS prev FROM busy WHERE date < DATE '{FIRST_TEST_DATE}') q GROUP BY 1)""",
    f"""long AS (SELECT origin, 'naive' AS forecaster, rate AS actual, lag_7 AS predicted FROM lagged WHERE date >= DATE '{FIRST_TEST_DATE}'
        UNION ALL SELECT origin, 'seasonal_naive', rate, lag_7 FROM lagged WHERE date >= DATE '{FIRST_TEST_DATE}'
        UNION ALL SELECT origin, 'rolling_mean', rate, roll FROM lagged WHERE date >= DATE '{FIRST_TEST_DATE}')""",
)


def _curve(spark, sf_dir):
    lagged = series.add_lags(national(spark, sf_dir), horizon=7)
    test = lagged.where(F.col("date") >= F.lit(date.fromisoformat(FIRST_TEST_DATE)))
    return test.select("date", F.col("rate").alias("actual"), F.col("roll_mean_28").alias("predicted"))


_CURVE_SQL = f"""curve AS (SELECT date, rate AS actual, roll AS predicted FROM (SELECT *, avg(rate) OVER
    (ORDER BY date ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING) AS roll FROM national) q WHERE date >= DATE '{FIRST_TEST_DATE}')"""


QUERIES = {
    "national_series": (
        lambda spark, sf_dir: comparable(national(spark, sf_dir)),
        with_ctes("SELECT strftime(date, '%Y-%m-%d') AS date, flights, round(rate, 6) AS rate FROM national", _D, NATIONAL_SQL),
    ),
    "busiest_top_n": (
        lambda spark, sf_dir: series.busiest(inputs.daily_rows(spark, sf_dir), n=5),
        with_ctes("SELECT origin, count(*) AS flights FROM day_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", _D),
    ),
    "busiest_series": (
        lambda spark, sf_dir: comparable(busy(spark, sf_dir)),
        with_ctes("SELECT origin, strftime(date, '%Y-%m-%d') AS date, flights, round(rate, 6) AS rate FROM busy", _D, BUSIEST_SQL),
    ),
    "worst_days": (
        lambda spark, sf_dir: comparable(series.worst_days(national(spark, sf_dir))),
        with_ctes(
            """SELECT strftime(date, '%Y-%m-%d') AS date, flights, round(rate, 6) AS rate FROM
            (SELECT * FROM national ORDER BY rate DESC, date LIMIT 10) q""",
            _D,
            NATIONAL_SQL,
        ),
    ),
    "series_describe": (
        lambda spark, sf_dir: comparable(series.describe_series(national(spark, sf_dir))),
        with_ctes(
            """SELECT count(*) AS days, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date,
            round(min(rate), 6) AS min_rate, round(median(rate), 6) AS median_rate, round(max(rate), 6) AS max_rate FROM national""",
            _D,
            NATIONAL_SQL,
        ),
    ),
    "weekday_profile": (
        lambda spark, sf_dir: comparable(series.weekday_profile(national(spark, sf_dir))),
        with_ctes(
            """SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, round(avg(rate), 6) AS mean_rate, count(*) AS days
            FROM national GROUP BY 1""",
            _D,
            NATIONAL_SQL,
        ),
    ),
    "calendar_features": (
        _calendar,
        with_ctes(
            """SELECT strftime(n.date, '%Y-%m-%d') AS date, flights, round(rate, 6) AS rate,
            CAST(isodow(n.date) - 1 AS INTEGER) AS day_of_week, CAST(month(n.date) AS INTEGER) AS month,
            CAST(dayofyear(n.date) AS INTEGER) AS day_of_year, CAST(isodow(n.date) >= 6 AS INTEGER) AS is_weekend,
            CAST(off AS INTEGER) AS days_from_holiday, CAST(off = 0 AS INTEGER) AS is_holiday,
            CAST(abs(off) <= 3 AS INTEGER) AS near_holiday FROM national n JOIN nearest x ON x.date = n.date""",
            _D,
            NATIONAL_SQL,
            "dates AS (SELECT date FROM national)",
            HOLIDAYS_SQL,
        ),
    ),
    "lag_features_h1": _lagged(national, 1, None),
    "lag_features_h7": _lagged(national, 7, None),
    "lag_features_by_series": _lagged(busy, 7, "origin"),
    "lag_features_by_date": (_date_lags, _DATE_LAGS_SQL),
    "naive_forecast_scores_h1": _naive_scores(1),
    "naive_forecast_scores_h7": _naive_scores(7),
    "mase_per_series": (_series_mase, _SERIES_MASE_SQL),
    "curve_error": (
        lambda spark, sf_dir: comparable(series.curve_error(_curve(spark, sf_dir))),
        with_ctes(
            """SELECT round(median(abs(actual - predicted)), 6) AS median_error, round(max(abs(actual - predicted)), 6) AS worst_error,
            round(max(actual), 6) AS worst_day FROM curve""",
            _D,
            NATIONAL_SQL,
            _CURVE_SQL,
        ),
    ),
    "tall_curve": (
        lambda spark, sf_dir: comparable(series.tall_curve(_curve(spark, sf_dir))),
        with_ctes(
            """SELECT strftime(date, '%Y-%m-%d') AS date, series, round(rate, 6) AS rate FROM
            (SELECT date, 'actual' AS series, actual AS rate FROM curve UNION ALL SELECT date, 'predicted', predicted FROM curve) q""",
            _D,
            NATIONAL_SQL,
            _CURVE_SQL,
        ),
    ),
}
