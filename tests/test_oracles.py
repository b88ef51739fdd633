"""Every query that SQL can say, against DuckDB; the others must run and keep their shape."""

import pytest
from comparing import connect, differences

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
ROWS_ONLY = {
    # name -> columns that must be there
    "table_detail": {"num_files", "size_bytes", "partition_columns"},
    "seasonal_ar_forecast": {"origin", "date", "order", "actual", "predicted"},
    "seasonal_arma_forecast": {"origin", "date", "order", "actual", "predicted"},
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert differences(entry.queries()[name](spark, sf_dir), duck, ORACLES[name]) == ""
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.01")  # busy series need the bigger tables
    assert set(df.columns) == ROWS_ONLY[name]
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) | set(ROWS_ONLY) <= set(entry.queries())
