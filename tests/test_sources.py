import zipfile

import pytest

from punctuality.operators import quality
from punctuality.plans.train import build_logistic
from punctuality.sources import archives, tables

HEADER = "Year,Month,Origin,ArrDel15,"


def write_zip(folder, year, month, header=HEADER, rows=('2023,1,"BDL, CT","0.00",',), members=1, bom=False):
    folder.mkdir(exist_ok=True)
    with zipfile.ZipFile(folder / f"{year}_{month}.zip", "w") as z:
        for i in range(members):
            text = "\n".join([header, *rows]) + "\n"
            z.writestr(f"On_Time_{year}_{month}_{i}.csv", ("﻿" if bom else "") + text)
        z.writestr("readme.html", "<html></html>")


def test_headers(spark, tmp_path):
    write_zip(tmp_path / "raw", 2023, 1)
    write_zip(tmp_path / "raw", 2023, 12, bom=True)
    found = archives.headers(spark, str(tmp_path / "raw"))
    want = ["Year", "Month", "Origin", "ArrDel15", "_trailing"]
    assert archives.verify_headers(found) == want
    assert {(r.year, r.month) for r in found.collect()} == {(2023, 1), (2023, 12)}
    with pytest.raises(archives.HeaderMismatch, match="2023-01"):
        archives.verify_headers(found, [*want, "more"])


def test_header_mismatch_names_month_and_column(spark, tmp_path):
    write_zip(tmp_path / "raw", 2023, 1)
    write_zip(tmp_path / "raw", 2023, 2, header="Year,Month,Surprise,Origin,ArrDel15,")
    with pytest.raises(archives.HeaderMismatch, match="2023-02.*Surprise"):
        archives.verify_headers(archives.headers(spark, str(tmp_path / "raw")))
    write_zip(tmp_path / "raw", 2023, 2, header="Month,Year,Origin,ArrDel15,")
    with pytest.raises(archives.HeaderMismatch, match="positions \\[1, 2\\]"):
        archives.verify_headers(archives.headers(spark, str(tmp_path / "raw")))


def test_no_archives(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    with pytest.raises(FileNotFoundError):
        archives.verify_headers(archives.headers(spark, str(tmp_path / "raw")))


def test_exactly_one_member(spark, tmp_path):
    write_zip(tmp_path / "raw", 2023, 1, members=2)
    with pytest.raises(Exception, match="exactly one CSV member"):
        archives.headers(spark, str(tmp_path / "raw")).collect()


def test_extract_stage_and_curate(spark, tmp_path):
    raw, staging, out = (str(tmp_path / n) for n in ("raw", "staging", "table"))
    # The file's own month is 7 where the path says 1: the file wins.
    write_zip(tmp_path / "raw", 2023, 1, rows=('2023,7,"BDL, CT","0.00",', "2023,7,JFK,abc,"))
    write_zip(tmp_path / "raw", 2023, 2, rows=("2023,2,LAX,1.00,",) * 3)
    assert {(r.year, r.month) for r in archives.extract(spark, raw, staging).collect()} == {(2023, 1), (2023, 2)}
    assert archives.extract(spark, raw, staging).count() == 0  # staged already
    write_zip(tmp_path / "raw", 2023, 3, rows=("2023,3,SEA,,",))
    assert [(r.year, r.month) for r in archives.extract(spark, raw, staging).collect()] == [(2023, 3)]

    header = archives.verify_headers(archives.headers(spark, raw))
    text = tables.read_staged(spark, staging, header)
    assert sorted((r.Month, r.Origin) for r in text.collect()) == sorted(
        [("7", "BDL, CT"), ("7", "JFK"), *[("2", "LAX")] * 3, ("3", "SEA")]
    )
    types = {"Year": "int", "Month": "int", "Origin": "string", "ArrDel15": "double"}
    done = tables.curate(text, out, types)
    assert done.reconciled and done.rows_written == 6
    report = {r.column: (r.present, r.failed) for r in done.cast_report.collect()}
    assert report["ArrDel15"] == (5, 1) and report["Origin"] == (6, 0)
    assert spark.read.parquet(out).where("Month = 2").agg({"ArrDel15": "sum"}).first()[0] == 3.0
    # A later load into the same table counts its own months.
    later = tables.curate(text.where("Month = '3'"), out, types)
    assert later.reconciled and later.rows_written == 1 and spark.read.parquet(out).count() == 6


def test_inventory(spark, tmp_path):
    for month in (1, 3):
        write_zip(tmp_path / "raw", 2023, month)
    (tmp_path / "raw" / "2023_4.zip.part").write_bytes(b"x")
    present = archives.archives(spark, str(tmp_path / "raw")).select("year", "month")
    missing = archives.missing_months(present, (2022, 12), (2023, 4)).orderBy("year", "month").collect()
    assert [(r.year, r.month) for r in missing] == [(2022, 12), (2023, 2), (2023, 4)]
    assert archives.unfinished_downloads(spark, str(tmp_path / "raw")).count() == 1


def test_cast_counts(spark):
    raw = spark.createDataFrame([(v,) for v in ("7", "-3.00", "2.6", " 7", "abc", "", None)], "n string")
    r = quality.cast_profile(raw, {"n": "int"}).first()
    assert (r.row_count, r.present, r.failed, r.failure_rate) == (7, 5, 1, 0.2)


def test_reconcile_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "n int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "n int, s string")
    assert quality.result_diff(a, a.orderBy("s")).count() == 0
    assert {(r.n, r.surplus) for r in quality.result_diff(a, b).collect()} == {(1, 1), (3, -1)}
    r = quality.reconcile(a, b).first()
    assert (r.rows_read, r.rows_written, r.reconciled) == (3, 3, True)
    near = b.withColumn("v", b.n * 1.0), b.withColumn("v", b.n * 1.0 + 1e-9)
    assert quality.close_diff(*near, ["n", "s"], ["v"], 1e-6).count() == 0
    assert quality.close_diff(*near, ["n", "s"], ["v"], 1e-12).count() == 3
    with pytest.raises(ValueError):
        quality.result_diff(a, a.select("n"))


def test_bundle_must_be_whole(spark, tmp_path):
    with pytest.raises(tables.BundleMissing, match="metadata"):
        tables.load_bundle(spark, str(tmp_path / "nothing"))
    assert build_logistic(["origin", "month"])  # builds without data


def test_write_result(spark, tmp_path):
    tables.write_result(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path), "step")
    assert spark.read.json(str(tmp_path / "step")).first().s == "a"


def test_views_reach_the_files(spark, sf_dir):
    from punctuality.sources.tables import register_views

    files = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "customer")}
    assert register_views(files, "v_") == ["v_orders", "v_customer"]
    told = spark.sql("SELECT c_custkey, count(*) AS n FROM v_orders JOIN v_customer ON o_custkey = c_custkey GROUP BY c_custkey")
    assert told.count() == files["orders"].select("o_custkey").distinct().count()
    register_views({"orders": files["orders"].where("o_orderkey < 0")}, "v_")
    assert spark.table("v_orders").isEmpty()
