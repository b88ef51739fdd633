"""Frequent levels of categorical columns, learned on training rows only."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuality.contract import CATEGORICAL

# Most levels a tree model takes, and the name of the pooled rest.
MAX_LEVELS = 254
RARE = "OTHER"


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, n) for all columns from one scan; nulls are no level."""
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    )
    return (
        df.select(*columns)
        .select(pairs)
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_levels(counts: DataFrame, max_levels: int | None = MAX_LEVELS, min_count: int = 0) -> DataFrame:
    """The most frequent levels per column, the smaller name first on a tie.

    The filter on the row number lets every task keep only its own best rows before the
    shuffle, so the group that is ranked is bounded by tasks times ``max_levels``.
    """
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "level"))
    ranked = counts.where(F.col("n") >= min_count).withColumn("rank", rank)
    return ranked if max_levels is None else ranked.where(F.col("rank") <= max_levels)


def grouped(df: DataFrame, kept: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace every level that is not kept, null included, by the pooled one."""
    return df.withColumns(
        {c: F.when(F.col(c).isin(list(levels)), F.col(c)).otherwise(F.lit(RARE)) for c, levels in kept.items()}
    )


def grouped_by_join(df: DataFrame, column: str, kept: DataFrame) -> DataFrame:
    """As :func:`grouped`, for kept levels that are a table: ``kept`` is (level), at most
    MAX_LEVELS rows by construction of :func:`top_levels`, hence the broadcast."""
    look = kept.select(F.col("level").alias("_level"))
    return (
        df.join(F.broadcast(look), F.col(column) == F.col("_level"), "left")
        .withColumn(column, F.coalesce("_level", F.lit(RARE)))
        .drop("_level")
    )


def coverage(df: DataFrame, kept: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of rows whose level is kept, per column."""
    shares = df.agg(
        *[F.avg(F.coalesce(F.col(c).isin(list(v)), F.lit(False)).cast("int")).alias(c) for c, v in kept.items()]
    )
    return shares.unpivot([], list(kept), "column", "coverage")


class _RareParams(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    maxLevels = Param(Params._dummy(), "maxLevels", "most levels kept per column, 0 for all", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "fewest training rows of a kept level", TypeConverters.toInt)
    kept = Param(Params._dummy(), "kept", "kept levels per column as JSON", TypeConverters.toString)


class RareLevels(Estimator, _RareParams):
    """Learns which levels to keep; later rows, and levels never seen, fall into the rest."""

    @keyword_only
    def __init__(self, *, inputCols=CATEGORICAL, maxLevels=MAX_LEVELS, minCount=0):
        super().__init__()
        self._set(inputCols=list(inputCols), maxLevels=maxLevels, minCount=minCount)

    def _fit(self, dataset):
        columns = [c for c in self.getInputCols() if c in dataset.columns]
        top = top_levels(
            level_counts(dataset, columns), self.getOrDefault("maxLevels") or None, self.getOrDefault("minCount")
        )
        # The kept levels come to the driver, as the labels of an indexer and the coefficients of
        # a one-hot model do.
        kept: dict[str, list[str]] = {c: [] for c in columns}
        for row in top.select("column", "level").orderBy("column", "rank").collect():
            kept[row["column"]].append(row["level"])
        return RareLevelsModel()._set(inputCols=columns, kept=json.dumps(kept))


class RareLevelsModel(Model, _RareParams):
    def levels(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault("kept"))

    def _transform(self, dataset):
        return grouped(dataset, self.levels())

    def coverage(self, dataset: DataFrame) -> DataFrame:
        return coverage(dataset, self.levels())
