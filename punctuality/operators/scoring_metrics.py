"""Ranking, calibration and cost metrics of scored rows, from one histogram of the scores.

Everything here needs only (score, rows, positives) per distinct score. The rows are read
once and merged on the map side; what comes after works on distinct scores. Cumulative sums
go cell by cell, a cell being a range of scores, so that no task ever sees all scores in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuality.functions.numbers import clip_probability, ratio, sound_probability
from punctuality.session import materialised

# Thresholds of the sweep, costs of a missed delay relative to a false alarm,
# calibration bins, and the fall in a mapped score that is taken as rounding.
THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
COST_RATIOS = (1.0, 2.0, 3.0, 5.0, 10.0)
BINS = 10
RANK_TOLERANCE = 1e-12


def bin_edges(bins: int = BINS) -> list[float]:
    """Interior edges as the doubles that evenly spaced steps give (0.1 * 3, not 0.3)."""
    step = 1.0 / bins
    return [i * step for i in range(1, bins)]


def score_histogram(scored: DataFrame, keys: Sequence[str] = (), *, label: str = "label", prob: str = "prob") -> DataFrame:
    """(keys, score, n, pos): labelled rows and positives per distinct clipped score.

    Rows without a label are left out; a labelled row without a probability is an error.
    """
    labelled = scored.where(F.col(label).isNotNull())
    return labelled.groupBy(*keys, clip_probability(sound_probability(F.col(prob))).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )


def celled(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_cell``, never falling along the score of the same keys; written once.

    A cell is a range partition of (keys, score), so cells are even however the scores lie: Spark
    cuts them by a sample of the distinct scores that is bounded per partition, and there are as
    many as the session has shuffle partitions. Ranges follow the keys, so there are at most as
    many (keys, cell) pairs as cells and keys together. The table is written, since two reads
    must see the same cuts.
    """
    if "_cell" in histogram.columns:
        return histogram
    cells = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = histogram.repartitionByRange(cells, *keys, "score")
    return materialised(ranged.withColumn("_cell", F.spark_partition_id()), "ranges")


def with_sums_above(histogram: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``above_<c>``, the total of ``c`` over strictly higher scores of the same keys.

    The total of all higher cells enters each cell as one extra row that sorts first, so the
    running sum inside the cell already includes it and no join is needed.
    """
    keys = list(keys)
    cells = celled(histogram, keys)
    higher = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(F.col("_cell").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cells.groupBy(*keys, "_cell")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            *keys,
            "_cell",
            *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c) for c in sums],
            F.lit(True).alias("_offset"),
        )
    )
    before = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(F.col("_offset").desc(), F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cells.withColumn("_offset", F.lit(False))
        .unionByName(offsets, allowMissingColumns=True)
        .withColumns({f"above_{c}": F.sum(c).over(before) for c in sums})
        .where(~F.col("_offset"))
        .drop("_cell", "_offset")
    )


def ranking(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum) and tie-aware ROC-AUC per keys; null without both classes."""
    pos, n = F.col("pos"), F.col("n")
    neg = n - pos
    flagged_pos, flagged = F.col("above_pos") + pos, F.col("above_n") + n
    # Negatives ranked at or above each positive, ties for one half.
    lost = pos.cast("double") * ((F.col("above_n") - F.col("above_pos")) + neg / 2.0)
    positives, negatives = F.sum(pos), F.sum(neg)
    area = 1.0 - F.try_divide(F.sum(lost), positives.cast("double") * negatives.cast("double"))
    return (
        with_sums_above(histogram, keys, ["pos", "n"])
        .groupBy(*keys)
        .agg(
            F.try_divide(F.sum(pos * flagged_pos / flagged), positives).alias("pr_auc"),
            F.when(F.count(F.lit(1)) == 1, F.lit(0.5)).otherwise(area).alias("roc_auc"),
        )
    )


def average_precision(scored: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    return ranking(score_histogram(scored, keys, **columns), keys).drop("roc_auc")


def roc_auc(scored: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    return ranking(score_histogram(scored, keys, **columns), keys).drop("pr_auc")


def _bin(score: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the score, so 1.0 is in the top bin."""
    index = F.lit(0)
    for edge in edges:
        index = index + (score >= F.lit(edge)).cast("int")
    return index


def calibration(histogram: DataFrame, keys: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Observed rate against mean score per equal-width bin; empty bins do not appear."""
    edges = bin_edges(bins)
    n = F.sum("n")
    mean, rate = F.sum(F.col("score") * F.col("n")) / n, F.sum("pos") / n
    bounds = F.array(*[F.lit(e) for e in [0.0, *edges, 1.0]])
    return (
        histogram.groupBy(*keys, _bin(F.col("score"), edges).alias("bin"))
        .agg(n.alias("count"), mean.alias("mean_predicted"), rate.alias("observed_rate"))
        .withColumns(
            {
                "lower": F.element_at(bounds, F.col("bin") + 1),
                "upper": F.element_at(bounds, F.col("bin") + 2),
                "gap": F.col("mean_predicted") - F.col("observed_rate"),
            }
        )
    )


def losses(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p, pos, n = F.col("score"), F.col("pos"), F.col("n")
    neg, total = n - pos, F.sum("n")
    return histogram.groupBy(*keys).agg(
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / total).alias("brier"),
        (F.sum(-(pos * F.log(p) + neg * F.log(1 - p))) / total).alias("log_loss"),
        (F.sum(pos) / total).alias("positive_rate"),
        total.alias("n"),
    )


def evaluate(
    scored: DataFrame, keys: Sequence[str] = ("model",), *, label: str = "label", prob: str = "prob", bins: int = BINS
) -> DataFrame:
    """All metrics, one row per keys (for instance scenario and model); one row without keys."""
    if not keys:
        one = scored.withColumn("_all", F.lit(0))
        return evaluate(one, ["_all"], label=label, prob=prob, bins=bins).drop("_all")
    keys = list(keys)
    histogram = celled(score_histogram(scored, keys, label=label, prob=prob), keys)
    gaps = calibration(histogram, keys, bins).groupBy(*keys).agg(F.max(F.abs("gap")).alias("max_calibration_gap"))
    # The joined tables have one row per model.
    return (
        ranking(histogram, keys)
        .join(losses(histogram, keys), keys)
        .join(gaps, keys)
        .withColumn("lift_over_base_rate", F.try_divide("pr_auc", "positive_rate"))
    )


def operating_points(
    scored: DataFrame,
    keys: Sequence[str] = (),
    thresholds: Sequence[float] = THRESHOLDS,
    *,
    label: str = "label",
    prob: str = "prob",
) -> DataFrame:
    """Confusion counts and rates per threshold; a score equal to the threshold is flagged.

    One pass and one aggregate for all thresholds. Rows without a label are left out.
    """
    scored = scored.where(F.col(label).isNotNull())
    late = F.col(label) == 1
    sums = []
    for i, t in enumerate(thresholds):
        flagged = F.col(prob) >= F.lit(float(t))
        sums += [
            F.count_if(flagged).alias(f"_flagged_{i}"),
            F.count_if(flagged & late).alias(f"_tp_{i}"),
        ]
    per_threshold = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.col(f"_flagged_{i}").alias("predicted_positive"),
                    F.col(f"_tp_{i}").alias("true_positive"),
                    (F.col(f"_flagged_{i}") - F.col(f"_tp_{i}")).alias("false_positive"),
                    (F.col("_late") - F.col(f"_tp_{i}")).alias("false_negative"),
                    (F.col("_rows") - F.col("_late") - F.col(f"_flagged_{i}") + F.col(f"_tp_{i}")).alias("true_negative"),
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    counted = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(late).alias("_late"), *sums
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return (
        counted.select(*keys, per_threshold)
        .withColumns(
            {
                "precision": ratio(tp, tp + fp),
                "recall": ratio(tp, tp + fn),
                "alert_rate": ratio(F.col("predicted_positive"), tp + fp + fn + tn),
            }
        )
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def expected_cost(missed_cost: Column) -> Column:
    """Cost per row of an operating point, a false alarm costing one."""
    fp, fn = F.col("false_positive"), F.col("false_negative")
    rows = F.col("true_positive") + fp + fn + F.col("true_negative")
    return ratio(fp + missed_cost * fn, rows)


def cost_optimum(points: DataFrame, keys: Sequence[str] = (), ratios: Sequence[float] = COST_RATIOS) -> DataFrame:
    """Cheapest threshold for each assumed cost of a miss; the lowest one on a tie."""
    priced = points.withColumn("cost_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    columns = ("threshold", "precision", "recall", "alert_rate")
    cost = expected_cost(F.col("cost_ratio"))
    best = F.min_by(
        F.struct(cost.alias("expected_cost"), *columns), F.struct(cost.alias("c"), F.col("threshold").alias("t"))
    )
    return priced.groupBy(*keys, "cost_ratio").agg(best.alias("best")).select(*keys, "cost_ratio", "best.*")


def ranking_preserved(
    pairs: DataFrame, before: str, after: str, keys: Sequence[str] = (), tolerance: float = RANK_TOLERANCE
) -> DataFrame:
    """Whether a remapped score keeps the order: ``after`` never falls as ``before`` rises.

    Rows with equal ``before`` have no order and are not compared with each other. The last
    value of a cell is carried into the next cell as one row.
    """
    keys = list(keys)
    spans = celled(
        pairs.groupBy(*keys, F.col(before).alias("score")).agg(F.min(after).alias("low"), F.max(after).alias("high")), keys
    )
    over_cells = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")
    carried = (
        spans.groupBy(*keys, "_cell")
        # "low" only keeps both branches on the same aggregate, so that its shuffle is reused.
        .agg(F.max_by("high", "score").alias("high"), F.max_by("low", "score").alias("low"))
        .withColumn("_cell", F.lead("_cell").over(over_cells))
        .where(F.col("_cell").isNotNull())
        .withColumn("_carried", F.lit(True))
    )
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(F.col("_carried").desc(), "score")
    falls = F.col("low") < F.lag("high").over(in_cell) - tolerance
    return (
        spans.withColumn("_carried", F.lit(False))
        .unionByName(carried, allowMissingColumns=True)
        .withColumn("falls", falls)
        .where(~F.col("_carried"))
        .groupBy(*keys)
        .agg((F.count_if("falls") == 0).alias("preserved"), F.count_if("falls").alias("reversals"))
    )
