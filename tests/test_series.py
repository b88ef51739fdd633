from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctuality.operators import series as s
from punctuality.operators.boosting import Settings, fit_many
from punctuality.plans import forecast


def ramp(spark, days, start=date(2023, 1, 1)):
    rows = [(start + timedelta(days=i), 0.1 + 0.3 * i / (days - 1)) for i in range(days)]
    return spark.createDataFrame(rows, "date date, rate double"), [r[1] for r in rows]


def test_lags_respect_the_horizon(spark):
    df, rates = ramp(spark, 60)
    rows = s.add_lags(df, horizon=7, rolling=(7,)).orderBy("date").collect()
    assert not {"lag_1", "lag_2", "lag_3"} & set(rows[0].asDict())
    assert rows[40].lag_7 == rates[33]
    assert rows[40].roll_mean_7 == pytest.approx(np.mean(rates[27:34]))
    assert rows[12].roll_mean_7 is None and rows[13].roll_mean_7 is not None
    with pytest.raises(ValueError):
        s.add_lags(df, horizon=0)


def test_no_future_in_any_lag(spark):
    df, _ = ramp(spark, 60)
    day = date(2023, 2, 10)
    changed = df.withColumn("rate", F.when(F.col("date") > F.lit(day - timedelta(days=7)), 9.0).otherwise(F.col("rate")))
    at = F.col("date") == F.lit(day)
    names = s.lag_names(7)
    a, b = (s.add_lags(x, horizon=7).where(at).select(names).first() for x in (df, changed))
    assert a == b


def test_groups_do_not_mix(spark):
    df, _ = ramp(spark, 10)
    two = df.withColumn("origin", F.lit("A")).unionByName(df.withColumn("origin", F.lit("B")))
    rows = s.add_lags(two, horizon=1, lags=(1,), rolling=(), group="origin").where("lag_1 IS NULL")
    assert rows.count() == 2


def test_seasonal_scale(spark):
    ten = spark.createDataFrame([(date(2023, 1, 1) + timedelta(days=i), 0.1 * (i >= 7)) for i in range(10)], "date date, rate double")
    assert s.seasonal_scale(ten).first().scale == pytest.approx(0.1)
    for values in ([0.1] * 5, [0.2] * 30):
        short = spark.createDataFrame([(date(2023, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "date date, rate double")
        with pytest.raises(ValueError):
            s.check_scale(s.seasonal_scale(short))


def wavy(spark, days=500, seed=0):
    rng = np.random.default_rng(seed)
    y, rows = [0.2] * 14, []
    for i in range(days):
        y.append(0.05 + 0.3 * y[-1] + 0.5 * y[-7] + 0.02 * rng.standard_normal())
        rows.append((date(2022, 9, 1) + timedelta(days=i), float(y[-1])))
    return spark.createDataFrame(rows, "date date, rate double").coalesce(1), np.array([r[1] for r in rows])


@pytest.mark.parametrize("horizon", [1, 7])
def test_seasonal_autoregression_is_least_squares_on_the_known_days(spark, horizon):
    df, y = wavy(spark)
    first = date(2023, 10, 1)
    got = {r.date: r for r in forecast.seasonal_autoregression(df, horizon=horizon, first_test_date=first).collect()}
    start = date(2022, 9, 1)
    assert len(got) == 500 - (first - start).days
    # The same order by hand, for the second test month.
    block = date(2023, 11, 1)
    order = forecast.ORDERS[next(iter(got.values())).order]
    known, terms = forecast._terms(horizon, order)
    first_row = max(forecast._all_lags(horizon))
    known_until = (block - start).days - horizon  # the last day that was over at the first forecast
    x = lambda t: [1.0] + [sum(w * y[t - lag] for lag, w in term.items()) for term in terms]
    fixed = lambda t: sum(w * y[t - lag] for lag, w in known.items())
    days = range(first_row, known_until + 1)
    beta = np.linalg.lstsq(np.array([x(t) for t in days]), np.array([y[t] - fixed(t) for t in days]), rcond=None)[0]
    for offset in (0, 13, 29):
        t = (block - start).days + offset
        assert got[block + timedelta(days=offset)].predicted == pytest.approx(fixed(t) + np.dot(x(t), beta), abs=1e-9)


def test_autoregression_beats_the_seasonal_naive_forecast_and_sees_no_future(spark):
    df, y = wavy(spark)
    first = date(2023, 10, 1)
    one = {r.date: r.predicted for r in forecast.seasonal_autoregression(df, horizon=7, first_test_date=first).collect()}
    start = (first - date(2022, 9, 1)).days
    naive = np.mean(np.abs(y[start:] - y[start - 7 : -7]))
    assert np.mean([abs(y[(d - date(2022, 9, 1)).days] - p) for d, p in one.items()]) < naive
    # What happens in December is not in the forecasts up to 6 December.
    changed = df.withColumn("rate", F.when(F.col("date") >= F.lit(date(2023, 12, 1)), 0.9).otherwise(F.col("rate")))
    two = {r.date: r.predicted for r in forecast.seasonal_autoregression(changed, horizon=7, first_test_date=first).collect()}
    early = [d for d in one if d <= date(2023, 12, 7)]
    assert [one[d] for d in early] == pytest.approx([two[d] for d in early], abs=1e-12)


FEW = Settings(loss="squared", rounds=3, leaves=5, leaf_rows=5, rate=0.3)


def test_backtests_are_the_fits_of_a_loop_over_months(spark):
    """One call for two parts gives what a model per part and month gives, with and without gap."""
    df, _ = wavy(spark, 200)
    parts = {}
    for horizon, gap in ((7, True), (1, False)):
        lagged = s.add_lags(df, horizon=horizon, lags=(7, 14), rolling=(7,))
        parts[f"h{horizon}"] = forecast.Part(lagged, ["lag_7", "lag_14", "roll_mean_7"][: 2 + horizon // 7], horizon, date(2023, 2, 10), gap)
    got = forecast.backtests(parts, FEW)
    for name, part in parts.items():
        work = part.frame.na.drop(subset=[*part.features, "rate"])
        wanted = {}
        for block in forecast.month_blocks(work, part.first_test_date):
            known = work.where(F.col("date") < F.lit(block - timedelta(days=part.horizon - 1 if part.gap else 0)))
            model = fit_many(known.withColumn("k", F.lit("k")), "k", "rate", part.features, settings=FEW)
            test = work.where((F.trunc("date", "month") == F.lit(block)) & (F.col("date") >= F.lit(part.first_test_date)))
            wanted |= {r.date: r.p for r in test.select("date", model.column().alias("p")).collect()}
        assert {r.date: r.predicted for r in got[name].collect()} == wanted and len(wanted) > 30


def test_backtest_trains_on_the_past_only(spark):
    df, _ = wavy(spark, 200)
    lagged = s.add_lags(df, horizon=7, lags=(7,), rolling=(7,))
    out = forecast.rolling_origin_backtest(
        lagged, ["lag_7", "roll_mean_7"], horizon=7, first_test_date=date(2023, 2, 1), settings=FEW
    )
    assert out.count() == 200 - (date(2023, 2, 1) - date(2022, 9, 1)).days
    assert out.where("predicted IS NULL").count() == 0
    with pytest.raises(ValueError):
        forecast.month_blocks(df, date(2030, 1, 1))
