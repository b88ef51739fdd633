"""Monthly ZIP archives: headers, extraction to partitioned text, and what is missing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.functions.calendar import expected_months

# Fixed value: name given to the unnamed field that a trailing comma makes.
TRAILING_FIELD = "_trailing"
_LINES_PER_BATCH = 50_000


class HeaderMismatch(ValueError):
    """One archive's columns differ from the others'."""


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, year, month, content) of every ``<year>_<month>.zip`` below ``folder``.

    ``content`` is read only where it is selected.
    """
    name = F.regexp_extract("path", r"([0-9]{4}_[0-9]{1,2})\.zip$", 1)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .where(name != "")
        .select(
            "path",
            "length",
            F.split_part(name, F.lit("_"), F.lit(1)).cast("int").alias("year"),
            F.split_part(name, F.lit("_"), F.lit(2)).cast("int").alias("month"),
            "content",
        )
    )


def _csv_reader():
    """A function that opens the one CSV member of an archive as text.

    It and the functions around it are closed over nothing but the standard library and
    pandas, so executors need not have this package installed.
    """

    def text_of(content, path):
        import io
        import zipfile

        archive = zipfile.ZipFile(io.BytesIO(content))
        members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
        if len(members) != 1:
            raise ValueError(f"{path}: expected exactly one CSV member, found {members}")
        return io.TextIOWrapper(archive.open(members[0]), encoding="utf-8-sig", newline="")

    return text_of


def _first_lines(trailing: str = TRAILING_FIELD):
    text_of = _csv_reader()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                names = next(csv.reader(text_of(row.content, row.path)), [])
                if names and names[-1] == "":
                    names[-1] = trailing
                yield pd.DataFrame({"year": [row.year], "month": [row.month], "header": [names]})

    return read


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(year, month, header): one row per archive. Only the first line is unpacked."""
    return archives(spark, folder).mapInPandas(_first_lines(), "year int, month int, header array<string>")


def verify_headers(found: DataFrame, expected: Sequence[str] | None = None) -> list[str]:
    """The header that all archives share, in order; else an error with month and difference.

    The rows compared are one per archive; one differing archive is named, the earliest.
    """
    first = found.orderBy("year", "month").first()
    if first is None:
        raise FileNotFoundError("no raw archives")
    shared = list(expected) if expected is not None else list(first["header"])
    wanted = F.array(*[F.lit(c) for c in shared])
    odd = (
        found.where(F.col("header") != wanted)
        .select(
            "year",
            "month",
            F.array_sort(
                F.concat(F.array_except("header", wanted), F.array_except(wanted, F.col("header")))
            ).alias("difference"),
            # A mere change of order has no set difference, so the positions are named too.
            F.filter(
                F.transform(
                    F.arrays_zip(F.col("header").alias("got"), wanted.alias("want")),
                    lambda pair, i: F.when(~pair["got"].eqNullSafe(pair["want"]), i + 1),
                ),
                lambda i: i.isNotNull(),
            ).alias("positions"),
        )
        .orderBy("year", "month")
        .first()
    )
    if odd is not None:
        raise HeaderMismatch(
            f"{odd['year']}-{odd['month']:02d}: columns on one side only {odd['difference']}, "
            f"other names at positions {odd['positions']}"
        )
    return shared


def _lines(per_batch: int = _LINES_PER_BATCH):
    text_of = _csv_reader()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import islice

        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                text, start = text_of(row.content, row.path), 0
                while lines := [line.rstrip("\r\n") for line in islice(text, per_batch)]:
                    numbers = range(start, start + len(lines))
                    start += len(lines)
                    yield pd.DataFrame({"Year": row.year, "Month": row.month, "line_no": numbers, "value": lines})

    return read


def archive_lines(archive_rows: DataFrame) -> DataFrame:
    """(Year, Month, line_no, value): the lines of each archive's CSV member, header first.

    A ZIP member cannot be split, so an archive is one task's work; its lines leave the task
    in batches and are never held together.
    """
    return archive_rows.mapInPandas(_lines(), "Year int, Month int, line_no bigint, value string")


def staged_months(spark: SparkSession, staging: str) -> DataFrame:
    """(year, month) of the staged partitions, from file names alone."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(staging)
    except AnalysisException:
        return spark.createDataFrame([], "year int, month int")
    part = lambda name: F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).try_cast("int")
    return (
        files.select(part("Year").alias("year"), part("Month").alias("month"))
        .where("year IS NOT NULL AND month IS NOT NULL")
        .distinct()
    )


def extract(spark: SparkSession, folder: str, staging: str, *, force: bool = False) -> DataFrame:
    """Unpack every archive that is not staged yet to ``Year=Y/Month=M`` text.

    A month appears only when its write is committed. Returns (year, month) of what was
    written by this call.
    """
    verify_headers(headers(spark, folder))
    todo = archives(spark, folder)
    if not force:
        todo = todo.join(staged_months(spark, staging), ["year", "month"], "left_anti")
    done = spark.createDataFrame(todo.select("year", "month").collect(), "year int, month int")
    (
        archive_lines(todo)
        .sortWithinPartitions("Year", "Month", "line_no")
        .select("Year", "Month", "value")
        .write.partitionBy("Year", "Month")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .text(staging)
    )
    return done


def month_inventory(present: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(year, month, present) for every month that is expected. ``present`` is (year, month)."""
    have = present.select("year", "month").distinct().withColumn("_have", F.lit(True))
    return (
        expected_months(present.sparkSession, first, last)
        .join(have, ["year", "month"], "left")
        .select("year", "month", F.coalesce("_have", F.lit(False)).alias("present"))
    )


def missing_months(present: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    return expected_months(present.sparkSession, first, last).join(
        present.select("year", "month").distinct(), ["year", "month"], "left_anti"
    )


def unfinished_downloads(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of ``.part`` files: downloads that never ended."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.part")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
