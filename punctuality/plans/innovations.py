"""Seasonal forecasts with moving-average terms, by innovations regression.

A moving-average term is a regressor that nobody sees: the surprise of an earlier day. Two
least-squares fits stand in for a likelihood search. A long autoregression gives the surprises
(its residuals); the candidate orders are then regressions on lags of the series and lagged
surprises. Both fits are sums of products over rows, so all series, orders and monthly refits go
through the same two aggregates; only systems of a few terms are solved in Python.

For every refit the long autoregression is fitted anew on what was known before its month, and
surprises are taken with those coefficients. A forecast of a day uses days that were over
``horizon`` days before it. AIC comes from the second fit, on the days before the test.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuality.plans.forecast import _season_lag, _terms, _weighted, month_blocks
from punctuality.session import materialised

# The small grid of orders (lags, difference, moving-average terms) and of their
# seasonal parts.
ORDERS = ((1, 0, 0), (1, 0, 1), (2, 0, 1), (1, 1, 1))
SEASONAL_ORDERS = ((1, 0, 0), (1, 0, 1), (0, 1, 1))
#: Every candidate as ((p, d, q), (P, D, Q)).
CANDIDATES = tuple((order, seasonal) for order in ORDERS for seasonal in SEASONAL_ORDERS)
#: Lags of the long autoregression, in days before the day of the surprise.
LONG_LAGS = (1, 2, 3, 7, 14)
_SELECT = "select"
_TERMS = 6


def _series_terms(horizon: int, candidate: tuple) -> tuple[dict[int, int], list[dict[int, int]]]:
    (p, d, _), (sp, sd, _) = candidate
    return _terms(horizon, (p, d, sp, sd))


def _surprise_lags(horizon: int, candidate: tuple) -> list[int]:
    (_, _, q), (_, _, sq) = candidate
    return [horizon + i for i in range(q)] + [_season_lag(horizon) for _ in range(sq)]


def _lags_of_all(horizon: int) -> list[int]:
    lags = set(LONG_LAGS)
    for candidate in CANDIDATES:
        known, terms = _series_terms(horizon, candidate)
        lags |= set(known).union(*terms)
    return sorted(lags)


def _solver(terms: int):
    """Least squares from the sums of products of a group; unused terms stay at zero."""

    def solve(xx: pd.Series, xz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        betas, rss = [], []
        for a, b, c in zip(xx, xz, zz):
            b = np.asarray(b, dtype=float)
            beta = np.linalg.lstsq(np.asarray(a, dtype=float).reshape(terms, terms), b, rcond=1e-12)[0]
            betas.append(beta.tolist())
            rss.append(max(float(c - beta @ b), 0.0))
        return pd.DataFrame({"coefficients": betas, "rss": rss})

    return F.pandas_udf(solve, "coefficients array<double>, rss double")


def _fitted(rows: DataFrame, keys: Sequence[str], terms: int, *carried: str) -> DataFrame:
    """(keys, n, coefficients, rss) of ``z`` on ``x`` within each group."""
    x, z = F.col("x"), F.col("z")
    sums = [F.sum(x[i] * x[j]).alias(f"_a{i}_{j}") for i in range(terms) for j in range(i, terms)]
    sums += [F.sum(x[i] * z).alias(f"_b{i}") for i in range(terms)]
    totals = rows.groupBy(*keys).agg(*sums, F.sum(z * z).alias("_zz"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in carried])
    xx = F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") for i in range(terms) for j in range(terms)])
    xz = F.array(*[F.col(f"_b{i}") for i in range(terms)])
    found = totals.withColumn("_fit", _solver(terms)(xx, xz, F.col("_zz")))
    return found.select(*keys, *carried, "n", "_fit.coefficients", "_fit.rss")


def _dot(terms: int):
    total = F.lit(0.0)
    for i in range(terms):
        total = total + F.col("x")[i] * F.col("coefficients")[i]
    return total


def candidate_rows(
    series: DataFrame, *, horizon: int, first_test_date: date, keys: Sequence[str], column: str
) -> DataFrame:
    """Per refit, day and candidate: target ``z``, what is known of it, and regressors ``x``.

    ``trains`` and ``tests`` tell what a row is for in its refit. All candidates are fitted on
    the same days, so their AIC values compare.
    """
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    lags = _lags_of_all(horizon)
    base = series.select(*keys, "date", column, *[F.lag(column, n).over(by).alias(f"_l{n}") for n in lags])
    base = materialised(base.na.drop(), "innovations-lags")
    long = F.array(F.lit(1.0), *[F.col(f"_l{n}").cast("double") for n in LONG_LAGS])
    base = base.withColumn("x", long).withColumn("z", F.col(column).cast("double"))
    # (refit, known until, last day): the selection, then one per month.
    refits = [(_SELECT, first_test_date, first_test_date - timedelta(days=1))]
    for start in month_blocks(base, first_test_date):
        after = date(start.year + start.month // 12, start.month % 12 + 1, 1)
        refits.append((f"{start:%Y-%m}", start - timedelta(days=horizon - 1), after - timedelta(days=1)))
    table = F.array(*[F.struct(F.lit(n).alias("refit"), F.lit(u).alias("until"), F.lit(e).alias("end")) for n, u, e in refits])
    rows = base.select("*", F.inline(F.filter(table, lambda r: F.col("date") <= r["end"])))
    trains = F.col("date") < F.col("until")
    first = _fitted(rows.where(trains), [*keys, "refit"], len(LONG_LAGS) + 1).drop("n", "rss")
    told = rows.join(first, [*keys, "refit"]).withColumn("_e", F.col("z") - _dot(len(LONG_LAGS) + 1))
    within = Window.partitionBy(*keys, "refit").orderBy("date")
    surprises = sorted({n for c in CANDIDATES for n in _surprise_lags(horizon, c)})
    told = told.withColumns({f"_e{n}": F.lag("_e", n).over(within) for n in surprises}).na.drop(subset=[f"_e{n}" for n in surprises])
    structs = []
    for i, candidate in enumerate(CANDIDATES):
        known, terms = _series_terms(horizon, candidate)
        x = [F.lit(1.0), *[_weighted(t) for t in terms], *[F.col(f"_e{n}") for n in _surprise_lags(horizon, candidate)]]
        used = len(x)
        x += [F.lit(0.0)] * (_TERMS - used)
        structs.append(
            F.struct(
                F.lit(i).alias("order"),
                F.lit(used).alias("parameters"),
                _weighted(known).alias("known"),
                (F.col(column) - _weighted(known)).alias("z"),
                F.array(*x).alias("x"),
            )
        )
    tests = (F.col("refit") != _SELECT) & (F.date_format("date", "yyyy-MM") == F.col("refit")) & (F.col("date") >= F.lit(first_test_date))
    return told.select(*keys, "refit", "date", F.col(column).alias("actual"), trains.alias("trains"), tests.alias("tests"), F.inline(F.array(*structs)))


def order_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, order, aic) from the fits on the days before the test."""
    chosen = rows.where((F.col("refit") == _SELECT) & F.col("trains"))
    fits = _fitted(chosen, [*keys, "order"], _TERMS, "parameters")
    spread = F.greatest(F.col("rss") / F.col("n"), F.lit(1e-300))
    return fits.select(*keys, "order", (F.col("n") * F.log(spread) + 2 * (F.col("parameters") + 1)).alias("aic"))


def seasonal_arma(
    series: DataFrame, *, horizon: int, first_test_date: date, group: str | None = None, column: str = "rate"
) -> DataFrame:
    """Forecasts of the test days at ``horizon`` by the order of least AIC, refitted each month."""
    keys = [group] if group else []
    rows = materialised(
        candidate_rows(series, horizon=horizon, first_test_date=first_test_date, keys=keys, column=column), "innovations"
    )
    best = order_scores(rows, keys).groupBy(*keys).agg(F.min_by("order", F.struct("aic", "order")).alias("order"))
    best = materialised(best, "innovations-orders")  # a row per series
    chosen = rows.where(F.col("refit") != _SELECT).join(best, [*keys, "order"], "left_semi")
    fits = _fitted(chosen.where("trains"), [*keys, "refit"], _TERMS).drop("n", "rss")
    return chosen.where("tests").join(fits, [*keys, "refit"]).select(
        *keys, "date", "order", "actual", (F.col("known") + _dot(_TERMS)).alias("predicted")
    )
