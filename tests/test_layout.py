import pytest
from pyspark.sql import functions as F

from punctuality.operators import layout


@pytest.fixture(scope="module")
def rows(spark):
    """Two years; one origin has half of all rows."""
    i = F.col("id")
    return spark.range(8_000).select(
        (2023 + i % 2).cast("int").alias("Year"),
        F.when(i % 2 == 0, "ATL").otherwise(F.concat(F.lit("X"), (F.pmod(F.xxhash64("id"), F.lit(100))).cast("string"))).alias("Origin"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)).alias("b"),
        i.cast("double").alias("ArrDelay"),
    )


def test_clustered_files_are_narrow_and_capped(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    layout.write_layout(rows, path, partition_by=["Year"], cluster_by=["Origin"], max_records_per_file=500, files=8)
    table = spark.read.parquet(path)
    per_file = table.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    assert per_file.rows == 8_000 and per_file.most <= 500
    held = layout.files_holding(table, {"x42": F.col("Origin") == "X42"}).first()
    assert 0 < held.x42 <= 4 < held.files
    detail = layout.table_detail(spark, path, ["Year"]).first()
    assert (detail.num_files, detail.partition_columns) == (held.files, "Year") and detail.size_bytes > 0


def test_a_hot_value_is_spread_over_files(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    layout.write_layout(rows, path, cluster_by=["Origin"], files=8)
    most = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0]
    assert most < 2_500  # "ATL" alone has 4,000 rows


def test_month_slices(spark):
    months = [(2023, 1)] * 3 + [(2023, 2)] + [(2023, 3)] * 2
    df = spark.createDataFrame(months, "Year int, Month int")
    got = {r.months: r["rows"] for r in layout.rows_per_scale(df, (2023, 1), (1, 2, 3)).collect()}
    assert got == {1: 3, 2: 4, 3: 6}
    for n in (0, 25):
        with pytest.raises(ValueError):
            layout.month_slice((2023, 1), n)


def test_manifest_summary(spark):
    manifest = spark.createDataFrame([(2023, m, 1000) for m in range(1, 13)] + [(2024, 1, 0)], "year int, month int, bytes bigint")
    r = layout.manifest_summary(manifest, 2023, 2024).first()
    assert (r.probed, r.found, r.compressed_bytes, r.first_month, r.last_month, r.absent_years) == (24, 12, 12_000, 202301, 202312, "2024")
