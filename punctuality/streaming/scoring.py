"""Requests to answers, the same plan for a batch and for a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.operators.requests import decide, good_and_bad, request_features, split_priors

Predict = Callable[[DataFrame], DataFrame]


def model_predictor(model, keep: tuple[str, ...] = ()) -> Predict:
    """A fitted pipeline as a step that adds ``prob``."""

    def predict(features: DataFrame) -> DataFrame:
        return model.transform(features).withColumn("prob", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction"
        )

    return predict


def prior_predictor(base_rate: float) -> Predict:
    """The origin's own rate as probability, the base rate where it is unknown."""
    return lambda features: features.withColumn("prob", F.coalesce("origin_prior_rate", F.lit(base_rate)))


def score_requests(requests: DataFrame, priors: DataFrame, predict: Predict, keep: tuple[str, ...] = ()) -> DataFrame:
    """Answers for the good requests.

    ``priors`` is the static long table; the planner joins its two lookups by their size.
    """
    good, _ = good_and_bad(requests)
    by_origin, by_carrier = split_priors(priors)
    keep = (*keep, "threshold")
    return decide(predict(request_features(good, by_origin, by_carrier, keep)))


def rejected_requests(requests: DataFrame) -> DataFrame:
    return good_and_bad(requests)[1]


def run_available(answers: DataFrame, path: str, checkpoint: str) -> None:
    """Answer everything that has arrived, append it to ``path``, and stop.

    The checkpoint makes a restart continue where the last run ended, each request once.
    """
    query = (
        answers.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def request_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
