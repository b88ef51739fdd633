"""Moving-average forecasts against a plain numpy version, series by series."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctuality.plans import innovations as I

START, FIRST = date(2022, 9, 1), date(2023, 6, 10)


def series_of(seed, days=340):
    rng = np.random.default_rng(seed)
    y, e = [0.2] * 14, [0.0] * 14
    for _ in range(days - 14):
        e.append(0.03 * rng.standard_normal())
        y.append(0.1 + 0.3 * y[-1] + 0.2 * y[-7] + e[-1] + 0.6 * e[-2])
    return np.array(y)


def plain(y, horizon):
    """{date: (order, forecast)} and the AIC of all candidates."""
    season = -(-horizon // 7) * 7
    day = lambda d: (d - START).days
    skipped = max(I._lags_of_all(horizon))
    long = lambda t: [1.0, *[y[t - n] for n in I.LONG_LAGS]]

    def regressors(candidate, t, e):
        (p, d, q), (sp, sd, sq) = candidate
        poly = {0: 1.0}
        for lag in [horizon] * d + [season] * sd:
            poly = {k: poly.get(k, 0) - poly.get(k - lag, 0) for k in {*poly, *[k + lag for k in poly]}}
        w = lambda s: sum(c * y[s - k] for k, c in poly.items())
        known = y[t] - w(t)
        x = [1.0] + [w(t - horizon - i) for i in range(p)] + [w(t - season - 7 * i) for i in range(1, sp + 1)]
        return known, x + [e[t - horizon - i] for i in range(q)] + [e[t - season]] * sq

    def fitted(until):
        """Surprises by what was known before ``until``, and second fits per candidate."""
        days = range(skipped, until)
        beta = np.linalg.lstsq(np.array([long(t) for t in days]), y[skipped:until], rcond=None)[0]
        e = {t: y[t] - np.dot(long(t), beta) for t in range(skipped, len(y))}
        rows, out = range(skipped + max(horizon, season), until), []
        for candidate in I.CANDIDATES:
            made = [regressors(candidate, t, e) for t in rows]
            x, z = np.array([m[1] for m in made]), np.array([y[t] - m[0] for t, m in zip(rows, made, strict=True)])
            b = np.linalg.lstsq(x, z, rcond=None)[0]
            rss = ((z - x @ b) ** 2).sum()
            out.append((b, len(rows) * np.log(rss / len(rows)) + 2 * (x.shape[1] + 1)))
        return e, out

    scores = [aic for _, aic in fitted(day(FIRST))[1]]
    order, found, start = int(np.argmin(scores)), {}, FIRST.replace(day=1)
    while day(start) < len(y):
        after = (start + timedelta(days=32)).replace(day=1)
        e, fits = fitted(day(start) - horizon + 1)
        for t in range(max(day(start), day(FIRST)), min(day(after), len(y))):
            known, x = regressors(I.CANDIDATES[order], t, e)
            found[START + timedelta(days=t)] = order, known + np.dot(x, fits[order][0])
        start = after
    return found, scores


@pytest.mark.parametrize("horizon", [1, 7])
def test_forecasts_are_the_plain_ones(spark, horizon):
    ys = {"A": series_of(1), "B": series_of(2)}
    df = spark.createDataFrame([(k, START + timedelta(days=t), float(v)) for k, y in ys.items() for t, v in enumerate(y)], "origin string, date date, rate double")
    got = I.seasonal_arma(df, horizon=horizon, first_test_date=FIRST, group="origin").collect()
    rows = I.candidate_rows(df, horizon=horizon, first_test_date=FIRST, keys=["origin"], column="rate")
    aic = {(r.origin, r.order): r.aic for r in I.order_scores(rows, ["origin"]).collect()}
    for name, y in ys.items():
        wanted, scores = plain(y, horizon)
        assert [aic[name, i] for i in range(12)] == pytest.approx(scores, abs=1e-5)
        mine = {r.date: (r.order, r.predicted) for r in got if r.origin == name}
        assert {d: o for d, (o, _) in mine.items()} == {d: o for d, (o, _) in wanted.items()}
        assert [mine[d][1] for d in wanted] == pytest.approx([p for _, p in wanted.values()], abs=1e-7)
    assert len({r.order for r in got}) >= 1 and len(got) == 2 * (340 - (FIRST - START).days)


def test_one_series_and_no_future(spark):
    y = series_of(3)
    df = spark.createDataFrame([(START + timedelta(days=t), float(v)) for t, v in enumerate(y)], "date date, rate double")
    one = {r.date: r.predicted for r in I.seasonal_arma(df, horizon=1, first_test_date=FIRST).collect()}
    assert set(one) == set(plain(y, 1)[0])
    late = date(2023, 7, 20)
    changed = df.withColumn("rate", F.when(F.col("date") >= F.lit(late), 0.9).otherwise(F.col("rate")))
    two = {r.date: r.predicted for r in I.seasonal_arma(changed, horizon=1, first_test_date=FIRST).collect()}
    assert [one[d] for d in one if d <= late] == pytest.approx([two[d] for d in one if d <= late], abs=1e-12)
