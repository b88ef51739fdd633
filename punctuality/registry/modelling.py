"""Queries over splits, baselines, models and forecasts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from punctuality.contract import FEATURES_BEFORE_DEPARTURE, SCENARIOS
from punctuality.functions.calendar import add_calendar_features, month_index
from punctuality.operators import categories, importance, rates, splits
from punctuality.operators import scoring_metrics as sm
from punctuality.plans import forecast, innovations, inputs, train
from punctuality.plans.model_table import model_table, with_priors
from punctuality.registry.daily import FIRST_TEST_DATE, busy, national
from punctuality.registry.metrics import HIST_SQL
from punctuality.registry.shared import comparable, with_ctes
from punctuality.session import shared_folder
from punctuality.sources.tables import load_bundle, write_model_table

_M = inputs.MONTHLY_SQL
TRAIN_YEAR, TEST_YEAR = 1999, 2000
_MAX_LEVELS = categories.MAX_LEVELS
_KEY = "row_key"


def yearly_model_table(spark, sf_dir):
    """The model table is written once per query and read by every fit, as a user would."""
    path = shared_folder(spark, "model-table")
    write_model_table(model_table(inputs.yearly_flights(spark, sf_dir), period="month", keep=(_KEY,)), path)
    return spark.read.parquet(path)


def _facts_of(spark, sf_dir, year):
    return inputs.monthly_facts(spark, sf_dir).where(F.col("year") == year)


def _baselines(spark, sf_dir):
    rows = inputs.monthly_facts(spark, sf_dir).withColumn("period", month_index(F.col("year"), F.col("month")))
    table = with_priors(rows, rows)
    fit, test = splits.train_test(table, ["origin_prior_rate", "carrier_prior_rate"], TRAIN_YEAR, TEST_YEAR)
    scored = train.baseline_scores(fit, test)
    return comparable(sm.evaluate(scored).select("model", "pr_auc", "roc_auc", "brier", "n"))


_BASELINE_SQL = with_ctes(
    """SELECT r.model, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier, n FROM ranked r
    JOIN (SELECT model, avg((prob - label) * (prob - label)) AS brier, count(*) AS n FROM
        (SELECT model, least(greatest(prob, 1e-15), 1 - 1e-15) AS prob, label FROM scored) c GROUP BY 1) l ON l.model = r.model""",
    _M,
    "by_origin AS (SELECT origin AS k, year * 12 + month AS p, avg(label) AS rate FROM facts GROUP BY 1, 2)",
    "by_carrier AS (SELECT carrier AS k, year * 12 + month AS p, avg(label) AS rate FROM facts GROUP BY 1, 2)",
    f"base AS (SELECT avg(label) AS b FROM facts WHERE year = {TRAIN_YEAR})",
    f"""test_rows AS (SELECT label, (SELECT b FROM base) AS b, o.rate AS orate, c.rate AS crate FROM facts f
        LEFT JOIN by_origin o ON o.k = f.origin AND o.p = year * 12 + month - 1
        LEFT JOIN by_carrier c ON c.k = f.carrier AND c.p = year * 12 + month - 1 WHERE year = {TEST_YEAR})""",
    """scored AS (SELECT 'base rate' AS model, b AS prob, label FROM test_rows
        UNION ALL SELECT 'origin prior', coalesce(orate, b), label FROM test_rows
        UNION ALL SELECT 'carrier prior', coalesce(crate, b), label FROM test_rows)""",
    HIST_SQL,
)


def _counts(fit, held):
    both = fit.select("month", F.lit(0).alias("h")).unionByName(held.select("month", F.lit(1).alias("h")))
    return both.groupBy("month").agg(F.count_if(F.col("h") == 0).alias("fit_rows"), F.count_if(F.col("h") == 1).alias("held_rows"))


def _month_holdout(spark, sf_dir):
    return _counts(*splits.by_month(_facts_of(spark, sf_dir, TRAIN_YEAR)))


def _stratified(spark, sf_dir):
    return _counts(*splits.stratified_by_month(_facts_of(spark, sf_dir, TRAIN_YEAR), _KEY))


_LEVEL_COLUMNS = ("origin", "dest", "carrier")


def _top(spark, sf_dir):
    counts = categories.level_counts(_facts_of(spark, sf_dir, TRAIN_YEAR), _LEVEL_COLUMNS)
    return categories.top_levels(counts, _MAX_LEVELS)


def _kept(spark, sf_dir):
    grouper = categories.RareLevels(inputCols=list(_LEVEL_COLUMNS), maxLevels=_MAX_LEVELS)
    return grouper.fit(_facts_of(spark, sf_dir, TRAIN_YEAR))


def _rare_grouped(spark, sf_dir):
    """Rows per pooled origin of the test year, the levels kept as a table."""
    kept = _top(spark, sf_dir).where(F.col("column") == "origin").select("level")
    pooled = categories.grouped_by_join(_facts_of(spark, sf_dir, TEST_YEAR), "origin", kept)
    return pooled.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"))


LEVELS_SQL = f"""
train_rows AS (SELECT * FROM facts WHERE year = {TRAIN_YEAR}),
level_counts AS (SELECT 'origin' AS "column", origin AS level, count(*) AS n FROM train_rows GROUP BY 2
    UNION ALL SELECT 'dest', dest, count(*) FROM train_rows GROUP BY 2
    UNION ALL SELECT 'carrier', carrier, count(*) FROM train_rows GROUP BY 2),
kept AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS INTEGER) AS rank
    FROM level_counts) q WHERE rank <= {_MAX_LEVELS})"""


def _scores_of(build):
    def run(spark, sf_dir):
        table = yearly_model_table(spark, sf_dir)
        fit, test = splits.train_test(table, FEATURES_BEFORE_DEPARTURE, TRAIN_YEAR, TEST_YEAR, keep=(_KEY,))
        return train.predicted(build(fit).fit(fit), test).select(_KEY, "label", "prob")

    return run


def _evaluated(spark, sf_dir):
    table = yearly_model_table(spark, sf_dir)
    return train.evaluate_scenarios(table, TRAIN_YEAR, TEST_YEAR, SCENARIOS)


def _calibrated(spark, sf_dir):
    table = yearly_model_table(spark, sf_dir)
    fit, test = splits.train_test(table, FEATURES_BEFORE_DEPARTURE, TRAIN_YEAR, TEST_YEAR, keep=(_KEY,))
    metrics, kept = train.calibration_comparison(fit, test, FEATURES_BEFORE_DEPARTURE, _KEY)
    return metrics.join(kept, "holdout")


def _isotonic(spark, sf_dir):
    """A map fitted on one scored set, at every distinct score of it."""
    scored = inputs.scores(spark, sf_dir).where(F.col("model") == "tied").select("label", "prob")
    mapped = train.isotonic_scores(train.fit_isotonic(scored), scored)
    return comparable(mapped.groupBy("prob").agg(F.max("mapped").alias("mapped"), F.count(F.lit(1)).alias("rows")))


# The monotone fit as a formula: at each score, the highest over all starts at or below it of
# the lowest over all ends at or above it of the mean in between.
_ISOTONIC_SQL = with_ctes(
    """SELECT prob, round(max(least_mean), 6) AS mapped, any_value(n) AS rows FROM (
        SELECT i.prob, i.n, j.prob AS a, min((k.cp - j.cp + j.pos) / (k.cn - j.cn + j.n)) AS least_mean
        FROM cum i JOIN cum j ON j.prob <= i.prob JOIN cum k ON k.prob >= i.prob GROUP BY 1, 2, 3) q GROUP BY 1""",
    inputs.SCORES_SQL,
    """levels AS (SELECT prob, count(*) AS n, sum(label) AS pos FROM scored WHERE model = 'tied' GROUP BY 1)""",
    """cum AS (SELECT *, sum(n) OVER (ORDER BY prob) AS cn, sum(pos) OVER (ORDER BY prob) AS cp FROM levels)""",
)


def _importance(spark, sf_dir):
    table = yearly_model_table(spark, sf_dir)
    fit, test = splits.train_test(table, FEATURES_BEFORE_DEPARTURE, TRAIN_YEAR, TEST_YEAR, keep=(_KEY,))
    model = train.build_gradient_boosting(FEATURES_BEFORE_DEPARTURE).fit(fit)
    return importance.permutation_importance(
        lambda rows: train.predicted(model, rows), test, _KEY, FEATURES_BEFORE_DEPARTURE
    )


def _exported(spark, sf_dir):
    """Export a model, load it back, and score the test year from the bundle."""
    flights = inputs.yearly_flights(spark, sf_dir)
    table = yearly_model_table(spark, sf_dir)
    folder = shared_folder(spark, "bundle")
    routes = rates.routes(flights, min_flights=5)
    train.export(table, routes, folder, FEATURES_BEFORE_DEPARTURE, TRAIN_YEAR, TEST_YEAR)
    bundle = load_bundle(spark, folder)
    _, test = splits.train_test(table, FEATURES_BEFORE_DEPARTURE, TRAIN_YEAR, TEST_YEAR, keep=(_KEY,))
    return train.predicted(bundle.model, test).select(_KEY, "label", "prob")


_TEST_FROM = date.fromisoformat(FIRST_TEST_DATE)


def _backtest(spark, sf_dir):
    featured = add_calendar_features(national(spark, sf_dir))
    lagged = forecast.add_lags(featured, horizon=7)
    features = [*forecast.CALENDAR_FEATURES, *forecast.lag_names(7)]
    out = forecast.rolling_origin_backtest(lagged, features, horizon=7, first_test_date=_TEST_FROM)
    return out.select("date", F.col("rate").alias("actual"), "predicted")


def _seasonal_ar(spark, sf_dir):
    return forecast.seasonal_autoregression(
        busy(spark, sf_dir), horizon=7, first_test_date=_TEST_FROM, group="origin"
    )


def _seasonal_arma(spark, sf_dir):
    return innovations.seasonal_arma(busy(spark, sf_dir), horizon=7, first_test_date=_TEST_FROM, group="origin")


def _report(spark, sf_dir):
    return forecast.forecast_report(
        add_calendar_features(national(spark, sf_dir)),
        add_calendar_features(busy(spark, sf_dir)),
        date(2001, 10, 1),
    )


QUERIES = {
    "baseline_scores": (_baselines, _BASELINE_SQL),
    "month_holdout": (
        _month_holdout,
        with_ctes(
            f"""SELECT month, count(*) FILTER (WHERE month NOT IN (11, 12)) AS fit_rows,
            count(*) FILTER (WHERE month IN (11, 12)) AS held_rows FROM facts WHERE year = {TRAIN_YEAR} GROUP BY 1""",
            _M,
        ),
    ),
    "stratified_holdout": (
        _stratified,
        with_ctes(
            f"""SELECT month, count(*) - CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS fit_rows,
            CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS held_rows FROM facts WHERE year = {TRAIN_YEAR} GROUP BY 1""",
            _M,
        ),
    ),
    "rare_levels": (_top, with_ctes("SELECT * FROM kept", _M, LEVELS_SQL)),
    "rare_coverage": (
        lambda spark, sf_dir: comparable(_kept(spark, sf_dir).coverage(_facts_of(spark, sf_dir, TEST_YEAR))),
        with_ctes(
            " UNION ALL ".join(
                f"""SELECT '{c}' AS "column", round(avg(CAST({c} IN (SELECT level FROM kept WHERE "column" = '{c}') AS INTEGER)), 6) AS coverage
                FROM facts WHERE year = {TEST_YEAR}"""
                for c in _LEVEL_COLUMNS
            ),
            _M,
            LEVELS_SQL,
        ),
    ),
    "rare_grouped": (
        _rare_grouped,
        with_ctes(
            f"""SELECT CASE WHEN origin IN (SELECT level FROM kept WHERE "column" = 'origin') THEN origin ELSE 'OTHER' END AS origin,
            count(*) AS rows FROM facts WHERE year = {TEST_YEAR} GROUP BY 1""",
            _M,
            LEVELS_SQL,
        ),
    ),
    "logistic_scores": (
        _scores_of(lambda fit: train.build_logistic(FEATURES_BEFORE_DEPARTURE, rows=fit.count())),
        None,
    ),
    "gbt_scores": (
        _scores_of(lambda fit: train.build_gradient_boosting(FEATURES_BEFORE_DEPARTURE)),
        None,
    ),
    "model_evaluation": (_evaluated, None),
    "calibration_comparison": (_calibrated, None),
    "isotonic_map": (_isotonic, _ISOTONIC_SQL),
    "permutation_importance": (_importance, None),
    "export_and_load": (_exported, None),
    "gbt_backtest": (_backtest, None),
    "seasonal_ar_forecast": (_seasonal_ar, None),
    "seasonal_arma_forecast": (_seasonal_arma, None),
    "forecast_report": (_report, None),
}
