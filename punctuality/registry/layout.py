"""Queries over written copies of the tables: pruning, skipping, slices, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuality.operators import layout
from punctuality.plans import inputs
from punctuality.registry.shared import comparable, with_ctes
from punctuality.session import shared_folder

_M = inputs.MONTHLY_SQL
FIRST_MONTH = (1995, 1)
#: Files per written copy, so that there is something to skip at the size of the test tables.
TEST_FILES = 32


def _facts_by_month(spark, sf_dir):
    f = inputs.monthly_facts(spark, sf_dir)
    return f.withColumnsRenamed({"year": "Year", "month": "Month"})


def _partitioned(spark, sf_dir):
    path = shared_folder(spark, "by-month")
    layout.write_layout(_facts_by_month(spark, sf_dir), path, partition_by=["Year", "Month"])
    return spark.read.parquet(path)


def _answers(table, predicates):
    """Rows and mean distance per predicate."""
    out = None
    for p in predicates:
        one = table.where(p).agg(
            F.lit(p).alias("predicate"), F.count(F.lit(1)).alias("rows"), F.avg("distance").alias("mean_distance")
        )
        out = one if out is None else out.unionByName(one)
    return comparable(out)


_PREDICATES = ("Year = 1997", "Year = 1997 AND Month = 7", "origin = 'N05'", "origin IN ('N05','N17')")


def _partition_predicates(spark, sf_dir):
    return _answers(_partitioned(spark, sf_dir), _PREDICATES)


def _lineitem(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _found(rows, label):
    return rows.agg(
        F.lit(label).alias("wanted"), F.count(F.lit(1)).alias("rows"),
        F.sum("l_quantity").alias("quantity"),
        # Whole cents, so that the sum is exact in any order of the rows.
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count(F.lit(1)) / 100.0).alias("mean_price"),
    )


_FOUND_SQL = """SELECT '{label}' AS wanted, count(*) AS rows, round(sum(l_quantity), 6) AS quantity,
    round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0, 6) AS mean_price
    FROM lineitem WHERE {where}"""


def _clustered(spark, sf_dir, name, columns):
    path = shared_folder(spark, name)
    layout.write_layout(_lineitem(spark, sf_dir), path, cluster_by=columns, files=TEST_FILES)
    return spark.read.parquet(path)


def _by_supplier(spark, sf_dir):
    table = _clustered(spark, sf_dir, "clustered", ["l_suppkey"])
    return comparable(_found(table.where(F.col("l_suppkey").isin(50, 7)), "suppliers"))


def _by_either(spark, sf_dir):
    table = _clustered(spark, sf_dir, "clustered-twice", ["l_suppkey", "l_partkey"])
    by_part, by_supplier = table.where("l_partkey = 1000"), table.where("l_suppkey = 50")
    return comparable(_found(by_part, "part").unionByName(_found(by_supplier, "supplier")))


def _files_per_value(spark, sf_dir):
    """Files that hold one supplier, rows as they come and rows clustered."""
    wanted = {"files_for_supplier": F.col("l_suppkey") == 50}
    plain = shared_folder(spark, "plain")
    layout.write_layout(_lineitem(spark, sf_dir), plain, files=TEST_FILES)
    tables = {"as_it_comes": spark.read.parquet(plain), "clustered": _clustered(spark, sf_dir, "sorted", ["l_suppkey"])}
    parts = [layout.files_holding(t, wanted).select(F.lit(n).alias("layout"), "*") for n, t in tables.items()]
    return parts[0].unionByName(parts[1])


def _detail(spark, sf_dir):
    path = shared_folder(spark, "detail")
    facts = _facts_by_month(spark, sf_dir).drop("Month")
    layout.write_layout(facts, path, partition_by=["Year"], cluster_by=["origin"], max_records_per_file=500)
    return layout.table_detail(spark, path, ["Year"])


def _slices(spark, sf_dir):
    return layout.rows_per_scale(_facts_by_month(spark, sf_dir), FIRST_MONTH)


def _manifest(spark, sf_dir):
    """A feed manifest that grows with the data: a thousand bytes per row of the month."""
    return inputs.monthly_facts(spark, sf_dir).groupBy("year", "month").agg((F.count(F.lit(1)) * 1000).alias("bytes"))


_MANIFEST_SQL = "manifest AS (SELECT year, month, count(*) * 1000 AS bytes FROM facts GROUP BY 1, 2)"


QUERIES = {
    "partition_predicates": (
        _partition_predicates,
        with_ctes(
            " UNION ALL ".join(
                f"""SELECT '{p.replace("'", "''")}' AS predicate, count(*) AS rows, round(avg(distance), 6) AS mean_distance
                FROM facts WHERE {p}"""
                for p in _PREDICATES
            ),
            _M,
        ),
    ),
    "clustered_lookup": (_by_supplier, _FOUND_SQL.format(label="suppliers", where="l_suppkey IN (50, 7)")),
    "clustered_two_columns": (
        _by_either,
        _FOUND_SQL.format(label="part", where="l_partkey = 1000")
        + " UNION ALL "
        + _FOUND_SQL.format(label="supplier", where="l_suppkey = 50"),
    ),
    "files_per_value": (_files_per_value, None),
    "table_detail": (_detail, None),
    "month_slice_counts": (
        _slices,
        with_ctes(
            " UNION ALL ".join(
                f"""SELECT {n} AS months, count(*) FILTER (WHERE year * 100 + month <= {(1995 * 12 + n - 1) // 12 * 100 + (n - 1) % 12 + 1}) AS rows
                FROM facts"""
                for n in layout.SCALES
            ),
            _M,
        ),
    ),
    "manifest_summary": (
        lambda spark, sf_dir: layout.manifest_summary(_manifest(spark, sf_dir), 1993, 2003),
        with_ctes(
            """SELECT 132 AS probed, count(*) AS found, CAST(sum(bytes) AS BIGINT) AS compressed_bytes,
            min(year * 100 + month) AS first_month, max(year * 100 + month) AS last_month,
            (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM (SELECT unnest(range(1993, 2004)) AS y) r
                WHERE y NOT IN (SELECT year FROM manifest)) AS absent_years FROM manifest""",
            _M,
            _MANIFEST_SQL,
        ),
    ),
}
