"""Staged text to a typed table, tables on disk, result sets, and the served bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.contract import FLIGHTS, PARTITION_COLUMNS, raw_schema
from punctuality.functions.casts import typed
from punctuality.operators.quality import cast_counts, cast_report

#: Rows of a file of the model table at most.
MODEL_FILE_ROWS = 100_000
CONTRACT_TYPES = {f.name: f.dataType.simpleString() for f in FLIGHTS.fields}


def read_staged(spark: SparkSession, staging: str, header: Sequence[str]) -> DataFrame:
    """All fields as text, in feed order. The files' own Year and Month win over the path's."""
    return (
        spark.read.schema(raw_schema(header))
        .option("header", "true")
        .option("escape", '"')
        .csv(f"{staging}/Year=*/Month=*/*")
    )


def typed_select(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast each named column, null where the cast fails, names kept."""
    return raw.select([typed(F.col(c), kind).alias(c) for c, kind in types.items()])


def typed_flights(raw: DataFrame) -> DataFrame:
    """The contract's columns with its types and its availability tags."""
    out = typed_select(raw, CONTRACT_TYPES)
    return out.select([F.col(f.name).alias(f.name, metadata=f.metadata) for f in FLIGHTS.fields])


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = PARTITION_COLUMNS,
    mode: str = "overwrite",
    *,
    rebalance: bool = False,
    file_rows: int = 0,
) -> None:
    """Partitioned Parquet, ZSTD. Overwriting replaces only the partitions that are written.

    ``rebalance`` is for rows that are not yet grouped by the partition columns: one shuffle
    in which the adaptive planner merges small partitions and splits a hot one, instead of a
    file per task and partition. ``file_rows`` bounds the rows of a file (0: no bound), for
    tables whose rows cost more to work on than to read.
    """
    df = df.hint("rebalance", *partition_by) if rebalance else df
    (
        df.write.partitionBy(*partition_by)
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_rows)
        .mode(mode)
        .parquet(path)
    )


def write_model_table(table: DataFrame, path: str) -> None:
    """Model rows by year. They come out of a shuffle by vehicle, hence the rebalance.

    A file is one read task, and scoring a row takes a model's time: files of bounded rows let
    a year be scored by many tasks, however well it compresses.
    """
    write_table(table, path, ["year"], rebalance=True, file_rows=MODEL_FILE_ROWS)


@dataclass(frozen=True)
class Curation:
    rows_read: int
    rows_written: int
    cast_report: DataFrame

    @property
    def reconciled(self) -> bool:
        return self.rows_read == self.rows_written


def curate(
    raw: DataFrame,
    path: str,
    types: Mapping[str, str] = CONTRACT_TYPES,
    partition_by: Sequence[str] = PARTITION_COLUMNS,
) -> Curation:
    """Type and write ``raw``, counting rows and failed casts.

    One pass counts everything (all columns in one aggregate), one pass writes; neither
    shuffles rows, each task writes the partitions it reads. An observation on the write
    would save the first pass, but it leaves the session unable to run ML transformers
    (its manager cannot be serialised with their closures). What was written is counted from
    the files of the partitions that ``raw`` has; others, from earlier loads, do not count.
    """
    counts = raw.agg(*cast_counts(types))
    seen = counts.first()
    spark = raw.sparkSession
    rows = typed_select(raw, types)
    write_table(rows, path, partition_by)
    table = spark.read.parquet(path)
    loaded = rows.select(*[F.col(c).alias(f"_{c}") for c in partition_by]).distinct()
    same = reduce(lambda a, b: a & b, [table[c].eqNullSafe(loaded[f"_{c}"]) for c in partition_by])
    return Curation(
        int(seen["row_count"]),
        table.join(loaded, same, "left_semi").count(),
        cast_report(spark.createDataFrame([seen], counts.schema), types),
    )


def write_result(df: DataFrame, folder: str, name: str) -> None:
    """One result set per step, as JSON lines."""
    df.write.mode("overwrite").json(f"{folder}/{name}")


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> list[str]:
    """Temporary views of the session for SQL users, one per table; their names, in order.

    A view is a plan: filters and columns of a query still reach the files, and nothing is read here.
    A name that exists as a view is replaced.
    """
    for name, table in tables.items():
        table.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in tables]


class BundleMissing(FileNotFoundError):
    """A part of the served bundle is not there."""


@dataclass(frozen=True)
class Bundle:
    model: PipelineModel
    priors: DataFrame
    routes: DataFrame
    metadata: dict


def save_bundle(folder: str, model: PipelineModel, priors: DataFrame, routes: DataFrame, metadata: DataFrame) -> None:
    """Model, priors, routes and one row of metadata side by side. The metadata comes last,
    so that a bundle that has it is whole."""
    model.write().overwrite().save(f"{folder}/model")
    priors.write.mode("overwrite").parquet(f"{folder}/priors")
    routes.write.mode("overwrite").parquet(f"{folder}/routes")
    metadata.write.mode("overwrite").json(f"{folder}/metadata")


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    def part(name, read):
        try:
            return read(f"{folder}/{name}")
        except Exception as e:  # the readers raise different errors for a missing path
            if isinstance(e, AnalysisException) or "does not exist" in str(e).lower():
                raise BundleMissing(f"no {name} in {folder}; export a model first") from e
            raise

    metadata = part("metadata", spark.read.json).first()
    return Bundle(
        part("model", PipelineModel.load),
        part("priors", spark.read.parquet),
        part("routes", spark.read.parquet),
        metadata.asDict(),
    )
