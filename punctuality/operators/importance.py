"""How much average precision falls when one feature is shuffled among the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.operators.scoring_metrics import average_precision
from punctuality.operators.skew import hash_rank
from punctuality.operators.splits import exact_sample
from punctuality.session import materialised

# Repeats per feature, and the fall that counts as none.
REPEATS = 3
NOTHING = 1e-5
_BASELINE = "(none)"


def shuffled_variants(rows: DataFrame, key: str, features: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Each row once as it is, and once per feature and repeat with that feature replaced.

    Row i takes the value of the row that stands at place i in another hash order: a
    permutation made by one equi-join per repeat, the same multiset of values.
    """
    placed = hash_rank(rows, key, seed, "position")
    donors = None
    for r in range(1, repeats + 1):
        one = hash_rank(rows.select(key, *features), key, seed + r, "position").select(
            F.lit(r).alias("repeat"), "position", F.struct(*features).alias("donor")
        )
        donors = one if donors is None else donors.unionByName(one)
    swapped = [
        F.struct(
            F.lit(f).alias("feature"),
            *[(F.col(f"donor.{c}") if c == f else F.col(c)).alias(c) for c in features],
        )
        for f in features
    ]
    variants = placed.join(donors, "position").select("repeat", "label", F.inline(F.array(*swapped)))
    plain = rows.select(F.lit(0).alias("repeat"), "label", F.lit(_BASELINE).alias("feature"), *features)
    return variants.unionByName(plain)


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame],
    rows: DataFrame,
    key: str,
    features: Sequence[str],
    *,
    repeats: int = REPEATS,
    sample: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Mean and spread of the fall per feature, biggest first, and its share of the baseline.

    ``predict`` adds ``prob``. All variants are scored by one job. All rows take part unless the
    caller asks for a ``sample``; they are written to the shared folder first, since they are
    read once per repeat.
    """
    picked = rows.select(key, "label", *features)
    picked = exact_sample(picked, key, sample, seed) if sample else picked
    variants = shuffled_variants(materialised(picked, "importance"), key, features, repeats, seed)
    scored = predict(variants).select("feature", "repeat", "label", "prob")
    ap = average_precision(scored, ["feature", "repeat"])
    # One row per feature and repeat.
    ap = materialised(ap, "importance-scores")
    baseline = ap.where(F.col("feature") == _BASELINE).select("pr_auc").scalar()
    return (
        ap.where(F.col("feature") != _BASELINE)
        .withColumn("drop", baseline - F.col("pr_auc"))
        .withColumn("baseline", baseline)
        .groupBy("feature", "baseline")
        .agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))
        .withColumn("share", F.when(F.col("baseline") > 0, F.col("mean_drop") / F.col("baseline")).otherwise(0.0))
        .orderBy(F.col("mean_drop").desc(), "feature")
    )


def near_zero(importances: DataFrame) -> DataFrame:
    return importances.where(F.abs("mean_drop") < NOTHING)
