"""Models and what they must beat: baselines, logistic regression, boosted trees, calibration."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.contract import CATEGORICAL, SCENARIOS
from punctuality.functions.numbers import or_base_rate, within
from punctuality.operators.boosting import Boosted, HistogramBoosting, Settings, fit_many
from punctuality.operators.categories import MAX_LEVELS, RareLevels
from punctuality.operators.rates import recent_prior_rates
from punctuality.operators.scoring_metrics import (
    cost_optimum,
    evaluate,
    operating_points,
    ranking_preserved,
    score_histogram,
)
from punctuality.operators.splits import by_month, stratified_by_month, train_test
from punctuality.session import materialised
from punctuality.sources.tables import save_bundle

# Smallest level of the one-hot encoding, solver iterations, boosting rounds and
# learning rate.
MIN_LEVEL_ROWS = 50
LOGISTIC_ITERATIONS = 200
BOOSTING_ROUNDS = 200
LEARNING_RATE = 0.1
#: Below any value of the numeric features, for trees that know no missing values.
MISSING = -1e6


def _numeric(features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in CATEGORICAL]


def _categorical(features: Sequence[str]) -> list[str]:
    return [f for f in features if f in CATEGORICAL]


def _missing_flags(columns: Sequence[str], fill: float | None) -> SQLTransformer:
    flags = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}_missing" for c in columns)
    value = lambda c: f"CAST({c} AS DOUBLE)" if fill is None else f"coalesce(CAST({c} AS DOUBLE), {fill})"
    values = ", ".join(f"{value(c)} AS {c}_value" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {values}, {flags} FROM __THIS__")


def _indexer(columns: Sequence[str]) -> StringIndexer:
    # A level that first appears after training must not break the scoring.
    return StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_index" for c in columns], handleInvalid="keep"
    )


def build_logistic(features: Sequence[str], *, rows: int | None = None, max_iter: int = LOGISTIC_ITERATIONS) -> Pipeline:
    """One-hot levels, imputed and scaled numbers, L2-regularised logistic regression.

    ``rows`` is the number of training rows: a penalty of one against the summed loss is
    1/rows against Spark's mean loss.
    """
    numbers, levels = _numeric(features), _categorical(features)
    values, flags = [f"{c}_value" for c in numbers], [f"{c}_missing" for c in numbers]
    filled = [f"{c}_filled" for c in numbers]
    stages = [
        RareLevels(inputCols=levels, minCount=MIN_LEVEL_ROWS, maxLevels=0),
        _indexer(levels),
        OneHotEncoder(inputCols=[f"{c}_index" for c in levels], outputCols=[f"{c}_hot" for c in levels], dropLast=False),
        _missing_flags(numbers, None),
        Imputer(inputCols=values, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, *flags], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=[*[f"{c}_hot" for c in levels], "scaled"], outputCol="features"),
        LogisticRegression(
            featuresCol="features",
            labelCol="label",
            maxIter=max_iter,
            regParam=1.0 / rows if rows else 1e-6,
            standardization=False,
        ),
    ]
    return Pipeline(stages=stages)


def build_gradient_boosting(features: Sequence[str], *, max_iter: int = BOOSTING_ROUNDS) -> Pipeline:
    """Boosted trees on native categories and native missing values, with no early stop."""
    settings = {"rounds": max_iter, "rate": LEARNING_RATE}
    return Pipeline(
        stages=[
            HistogramBoosting(
                inputCols=[*_categorical(features), *_numeric(features)],
                categories=_categorical(features),
                settings=json.dumps(settings),
            )
        ]
    )


def fit_boosted(rows: DataFrame, key: str, features: Sequence[str], *, max_iter: int = BOOSTING_ROUNDS) -> Boosted:
    """As :func:`build_gradient_boosting`, a model for each value of ``key``, fitted side by side."""
    settings = Settings(rounds=max_iter, rate=LEARNING_RATE)
    return fit_many(rows, key, "label", _numeric(features), _categorical(features), settings)


def build_mllib_boosting(features: Sequence[str], *, max_iter: int = BOOSTING_ROUNDS, max_depth: int = 5, seed: int = 0) -> Pipeline:
    """MLlib's boosted trees, which know no missing values: a value below all others and a flag."""
    numbers, levels = _numeric(features), _categorical(features)
    stages = []
    if levels:
        stages += [RareLevels(inputCols=levels, maxLevels=MAX_LEVELS), _indexer(levels)]
    inputs = [f"{c}_index" for c in levels] + [f"{c}_value" for c in numbers] + [f"{c}_missing" for c in numbers]
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=LEARNING_RATE,
        # The kept levels, the pooled one, and the one for invalid entries.
        maxBins=MAX_LEVELS + 2,
        seed=seed,
    )
    return Pipeline(stages=[*stages, _missing_flags(numbers, MISSING), VectorAssembler(inputCols=inputs, outputCol="features"), trees])


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prob``, the probability of being late."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("prob"))


def baseline_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(label, model, prob) of the three forecasts that need no model."""
    base = train.agg(F.avg("label")).scalar()
    models = {
        "base rate": F.col("_base"),
        "origin prior": or_base_rate(F.col("origin_prior_rate"), F.col("_base")),
        "carrier prior": or_base_rate(F.col("carrier_prior_rate"), F.col("_base")),
    }
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("prob")) for n, p in models.items()]))
    return test.select("label", "origin_prior_rate", "carrier_prior_rate", base.alias("_base")).select("label", rows)


def scored_models(
    train: DataFrame, test: DataFrame, features: Sequence[str], *, logistic_iter: int = LOGISTIC_ITERATIONS
) -> DataFrame:
    """(label, model, prob) of baselines and the logistic regression over the test rows."""
    pipeline = build_logistic(features, rows=train.count(), max_iter=logistic_iter)
    scored = predicted(pipeline.fit(train), test).select("label", F.lit("logistic regression").alias("model"), "prob")
    return baseline_scores(train, test).unionByName(scored)


def evaluate_scenarios(
    table: DataFrame,
    train_year: int,
    test_year: int,
    scenarios: Mapping[str, Sequence[str]] = SCENARIOS,
    *,
    max_iter: int = BOOSTING_ROUNDS,
    logistic_iter: int = LOGISTIC_ITERATIONS,
) -> DataFrame:
    """One row of metrics per scenario and model, all scores in one pass.

    The boosted models of all scenarios are fitted side by side; a feature that a scenario does
    not know is missing in all its rows and splits nothing. Few tasks are busy with them, so the
    other models are fitted meanwhile.
    """
    every = list(dict.fromkeys(f for features in scenarios.values() for f in features))
    types = {f.name: f.dataType for f in table.schema.fields}
    out = fit_rows = test_rows = None
    for name, features in scenarios.items():
        known = [F.col(f) if f in features else F.lit(None).cast(types[f]).alias(f) for f in every]
        own = [df.select(F.lit(name).alias("scenario"), "label", *known) for df in train_test(table, features, train_year, test_year)]
        fit_rows = own[0] if fit_rows is None else fit_rows.unionByName(own[0])
        test_rows = own[1] if test_rows is None else test_rows.unionByName(own[1])
    with ThreadPoolExecutor(1) as beside:
        fitted = beside.submit(inheritable_thread_target(table.sparkSession)(fit_boosted), fit_rows, "scenario", every, max_iter=max_iter)
        for name, features in scenarios.items():
            one = scored_models(*train_test(table, features, train_year, test_year), features, logistic_iter=logistic_iter)
            one = one.withColumn("scenario", F.lit(name))
            out = one if out is None else out.unionByName(one)
        model = fitted.result()
    boosted = test_rows.select("scenario", "label", F.lit("gradient boosting").alias("model"), model.column(F.col("scenario")).alias("prob"))
    return evaluate(out.unionByName(boosted), ["scenario", "model"])


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest average precision of each scenario."""
    return metrics.groupBy("scenario").agg(
        F.max_by("model", F.struct("pr_auc", "model")).alias("model"), F.max("pr_auc").alias("pr_auc")
    )


def isotonic_points(scored: DataFrame) -> DataFrame:
    """(score, rate, weight): rows with equal scores as one weighted point, which leaves the
    fit unchanged. The fit itself pools violators within score ranges on the executors, and
    only the pooled blocks meet."""
    return score_histogram(scored).select(
        "score", (F.col("pos") / F.col("n")).alias("rate"), F.col("n").cast("double").alias("weight")
    )


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """Monotone map of ``prob`` to the observed rate."""
    return IsotonicRegression(
        featuresCol="score", labelCol="rate", weightCol="weight", predictionCol="mapped"
    ).fit(isotonic_points(scored))


def isotonic_scores(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """``scored`` with ``mapped``, clipped to [0, 1]."""
    mapped = model.transform(scored.withColumn("score", F.col("prob"))).drop("score")
    return mapped.withColumn("mapped", within(F.col("mapped"), 0.0, 1.0))


def calibration_comparison(
    train: DataFrame, test: DataFrame, features: Sequence[str], key: str, *, max_iter: int = BOOSTING_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Two ways to hold out rows for calibration, raw and mapped.

    Returns the metrics keyed (holdout, stage), and whether each map kept the ranking.
    """
    holdouts = {"named months": by_month(train), "share of every month": stratified_by_month(train, key)}
    rows = None
    for name, (fit, _) in holdouts.items():
        one = fit.select(F.lit(name).alias("holdout"), "label", *features)
        rows = one if rows is None else rows.unionByName(one)
    models = fit_boosted(rows, "holdout", features, max_iter=max_iter)
    scores = None
    for name, (_, held) in holdouts.items():
        raw = models.column(F.lit(name)).alias("prob")
        isotonic = fit_isotonic(held.select("label", raw))
        one = isotonic_scores(isotonic, test.select("label", raw)).select(F.lit(name).alias("holdout"), "label", "prob", "mapped")
        scores = one if scores is None else scores.unionByName(one)
    scores = materialised(scores, "calibrated")  # the models score the test rows once
    stages = F.inline(
        F.array(
            F.struct(F.lit("raw").alias("stage"), F.col("prob").alias("p")),
            F.struct(F.lit("isotonic").alias("stage"), F.col("mapped").alias("p")),
        )
    )
    metrics = evaluate(scores.select("holdout", "label", stages), ["holdout", "stage"], prob="p")
    return metrics, ranking_preserved(scores, "prob", "mapped", ["holdout"])


def decision_report(scored: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Operating points with counts beside rates, and the optimum per assumed cost."""
    points = operating_points(scored, keys)
    named = points.select(
        *keys,
        "threshold",
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "alert_rate")],
        F.col("predicted_positive").alias("warned"),
        F.col("true_positive").alias("correctly_warned"),
        F.col("false_positive").alias("false_alarms"),
        F.col("false_negative").alias("delays_missed"),
    )
    return named, cost_optimum(points, keys)


def export(
    table: DataFrame,
    routes: DataFrame,
    folder: str,
    features: Sequence[str],
    train_year: int,
    test_year: int,
    *,
    max_iter: int = BOOSTING_ROUNDS,
) -> DataFrame:
    """Fit on the training year, score the test year, and save everything serving needs.

    Returns the one row of metadata that is stored with the model.
    """
    train, test = train_test(table, features, train_year, test_year)
    model = build_gradient_boosting(features, max_iter=max_iter).fit(train)
    scored = predicted(model, test).select(F.lit("gradient boosting").alias("model"), "label", "prob")
    metadata = evaluate(scored).select(
        F.lit(str(train_year)).alias("trained_on"),
        F.lit(str(test_year)).alias("tested_on"),
        F.lit(",".join(features)).alias("features"),
        "pr_auc",
        "roc_auc",
        "brier",
    )
    row = metadata.first()
    kept = table.sparkSession.createDataFrame([row], metadata.schema)
    save_bundle(folder, model, recent_prior_rates(table), routes, kept)
    return kept
