"""How files are laid out, what they hold, and how a feed grows by months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month slices of the scale series.
SCALES = (1, 3, 6, 12, 24)


def delta_available(spark: SparkSession) -> bool:
    """Whether the session was started with Delta; tables are Parquet otherwise."""
    return "delta" in (spark.conf.get("spark.sql.extensions", None) or "").lower()


def read_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_layout(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    max_records_per_file: int | None = None,
    files: int | None = None,
    fmt: str = "parquet",
) -> None:
    """Rewrite a table with capped files, rows in the order of ``cluster_by``.

    Ranges are cut over (partition columns, cluster columns, row hash), so a file covers a
    narrow range of the whole table, and a value that holds a third of the rows is spread
    over many tasks. The sort starts with the partition columns: the writer demands that
    order, and a sort it had to add itself would undo ours.
    """
    if cluster_by:
        keys = [*partition_by, *cluster_by]
        spread = F.xxhash64(*df.columns)
        ranged = (
            df.repartitionByRange(files, *keys, spread) if files else df.repartitionByRange(*keys, spread)
        )
        df = ranged.sortWithinPartitions(*keys)
    elif files:
        df = df.repartition(files)
    writer = df.write.format(fmt).mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.save(path)


def table_detail(spark: SparkSession, path: str, partition_columns: Sequence[str] = ()) -> DataFrame:
    """Files, bytes and partition columns, from the file listing; no data is read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return listed.agg(
        F.count(F.lit(1)).alias("num_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes")
    ).withColumn("partition_columns", F.lit(",".join(partition_columns)))


def files_holding(table: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """One row: the files of a table, and of those the ones with a row of each wanted kind."""
    path = F.col("_metadata.file_path")
    held = [F.count_distinct(F.when(test, path)).alias(name) for name, test in wanted.items()]
    return table.agg(F.count_distinct(path).alias("files"), *held)


def month_slice(first: tuple[int, int], n_months: int, longest: int = 24) -> Column:
    """Rows of the first ``n_months``, by partition columns only, so that it prunes."""
    if not 1 <= n_months <= longest:
        raise ValueError(f"months must be in 1..{longest}, got {n_months}")
    last = first[0] * 12 + first[1] - 1 + n_months - 1
    return F.col("Year") * 100 + F.col("Month") <= (last // 12) * 100 + last % 12 + 1


def rows_per_scale(table: DataFrame, first: tuple[int, int], scales: Sequence[int] = SCALES) -> DataFrame:
    """Rows of each prefix of months, all counted in one pass."""
    counted = table.agg(*[F.count_if(month_slice(first, n, max(scales))).alias(f"_{n}") for n in scales])
    pairs = [F.struct(F.lit(n).alias("months"), F.col(f"_{n}").alias("rows")) for n in scales]
    return counted.select(F.inline(F.array(*pairs)))


def manifest_summary(manifest: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """What a feed holds, from (year, month, bytes): months probed and found, bytes, span, gaps."""
    found = manifest.where(F.col("bytes") > 0)
    spark = manifest.sparkSession
    absent = (
        spark.range(first_year, last_year + 1)
        .select(F.col("id").cast("int").alias("year"))
        .join(found.select("year").distinct(), "year", "left_anti")
        .agg(F.concat_ws(",", F.array_sort(F.collect_list(F.col("year").cast("string")))).alias("absent"))
        .scalar()
    )
    month = F.col("year") * 100 + F.col("month")
    return found.agg(
        F.lit((last_year - first_year + 1) * 12).alias("probed"),
        F.count(F.lit(1)).alias("found"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("compressed_bytes"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
    ).withColumn("absent_years", absent)
