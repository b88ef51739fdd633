"""Queries over untyped text and over results: casts, inventory, reconciliation, equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuality.functions.labels import with_label
from punctuality.operators import layout, quality, rates, rotation
from punctuality.plans import inputs
from punctuality.registry.shared import comparable, with_ctes
from punctuality.session import shared_folder
from punctuality.sources import archives, tables

_R, _M = inputs.RAW_SQL, inputs.MONTHLY_SQL
_SQL_TYPES = {"int": "INTEGER", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR"}
FIRST_MONTH, LAST_MONTH = (1995, 1), (2001, 12)


def _typed(spark, sf_dir):
    out = tables.typed_select(inputs.raw_text(spark, sf_dir), inputs.RAW_TYPES)
    return comparable(out.withColumns({c: F.col(c).cast("double") for c in ("order_no", "customer")}))


_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT (SELECT count(*) FROM raw) AS row_count, '{c}' AS "column", '{k}' AS declared_type, p AS present, f AS failed,
    round(CASE WHEN p > 0 THEN f / p ELSE 0 END, 6) AS failure_rate FROM (SELECT count(*) FILTER (WHERE {c} IS NOT NULL AND {c} <> '') AS p,
    count(*) FILTER (WHERE {c} IS NOT NULL AND {c} <> '' AND TRY_CAST({c} AS {_SQL_TYPES[k]}) IS NULL) AS f FROM raw) q_{c}"""
    for c, k in inputs.RAW_TYPES.items()
)


def _raw_by_month(spark, sf_dir):
    """The raw text with the year and month it belongs to, as text."""
    day = F.when(F.col("ordered").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("ordered"))
    return inputs.raw_text(spark, sf_dir).select(
        "*", F.coalesce(F.substring(day, 1, 4), F.lit("0")).alias("Year"), F.coalesce(F.substring(day, 6, 2), F.lit("0")).alias("Month")
    )


def _curated(spark, sf_dir):
    """Type, write by month and count in one pass, then read back: rows must reconcile."""
    path = shared_folder(spark, "curated")
    types = {**inputs.RAW_TYPES, "Year": "int", "Month": "int"}
    done = tables.curate(_raw_by_month(spark, sf_dir), path, types)
    written = spark.read.parquet(path)
    return done.cast_report.select(
        F.col("row_count").cast("bigint").alias("rows_read"),
        F.lit(done.rows_written).cast("bigint").alias("rows_written"),
        F.lit(int(done.reconciled)).alias("reconciled"),
        "column",
        F.col("failed").cast("bigint").alias("failed"),
        F.lit(written.where("Year = 1997 AND Month >= 6").count()).cast("bigint").alias("rows_of_slice"),
    )


_CURATED_SQL = with_ctes(
    " UNION ALL ".join(
        f"""SELECT (SELECT count(*) FROM raw) AS rows_read, (SELECT count(*) FROM raw) AS rows_written, 1 AS reconciled,
        '{c}' AS "column", (SELECT count(*) FROM raw WHERE {c} <> '' AND TRY_CAST({c} AS {_SQL_TYPES[k]}) IS NULL) AS failed,
        (SELECT count(*) FROM raw WHERE length(ordered) = 10 AND ordered >= '1997-06' AND ordered < '1998') AS rows_of_slice"""
        for c, k in inputs.RAW_TYPES.items()
    )
    + """ UNION ALL SELECT (SELECT count(*) FROM raw), (SELECT count(*) FROM raw), 1, m, 0,
        (SELECT count(*) FROM raw WHERE length(ordered) = 10 AND ordered >= '1997-06' AND ordered < '1998')
        FROM (SELECT unnest(['Year', 'Month']) AS m) u""",
    _R,
)


def _inventory(spark, sf_dir):
    present = inputs.monthly_facts(spark, sf_dir).select("year", "month")
    return comparable(archives.month_inventory(present, FIRST_MONTH, LAST_MONTH))


def _missing(spark, sf_dir):
    present = inputs.monthly_facts(spark, sf_dir).select("year", "month")
    return archives.missing_months(present, FIRST_MONTH, LAST_MONTH)


_EXPECTED_SQL = """expected AS (SELECT CAST(n // 12 AS INTEGER) AS year, CAST(n % 12 + 1 AS INTEGER) AS month
    FROM (SELECT unnest(range(1995 * 12, 2002 * 12)) AS n) u)"""


def _codes(spark, sf_dir):
    """Customers per labelled nation code; some codes are lower case, some have no name."""
    code = F.concat(F.when(F.col("c_custkey") % 2 == 0, "n").otherwise("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    named = inputs.table(spark, sf_dir, "nation").where("n_nationkey < 20").select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name")
    )
    customers = inputs.table(spark, sf_dir, "customer").select(code.alias("code"))
    return with_label(customers, "code", named).groupBy("code", "label").agg(F.count(F.lit(1)).alias("customers"))


def _digest(spark, sf_dir):
    result = rates.daily_rate_by_origin(inputs.legs(spark, sf_dir))
    # Rounded before it is summed, so that both engines sum the same cells.
    return quality.result_digest(comparable(result))


_DIGESTED = ("ArrDelay", "Dest", "DepDelay", "FlightDate", "Origin", "Tail_Number")


def _multiset(spark, sf_dir):
    """All legs as they are, and with two delays swapped, which sums of cells cannot tell apart."""
    legs = inputs.legs(spark, sf_dir).select(*_DIGESTED)
    swapped = legs.withColumns({"ArrDelay": F.col("DepDelay"), "DepDelay": F.col("ArrDelay")})
    both = legs.withColumn("version", F.lit("plain")).unionByName(swapped.withColumn("version", F.lit("swapped")))
    return quality.multiset_digest(comparable(both), ["version"])


def _multiset_sql():
    def text(c):
        value = f'CAST(CAST(round("{c}" * 1000000) AS HUGEINT) AS VARCHAR)' if "Delay" in c else f'CAST("{c}" AS VARCHAR)'
        return f"""'{c}=' || coalesce(length({value}) || ':' || {value}, '-')"""

    cells = " || '|' || ".join(text(c) for c in sorted((*_DIGESTED, "version")))
    columns = ", ".join(f'"{c}"' for c in _DIGESTED if "Delay" not in c)
    return with_ctes(
        f"""SELECT version, count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || '-'
        || CAST(bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS digest
        FROM (SELECT version, md5({cells}) AS h FROM both_versions) q GROUP BY version""",
        inputs.LEGS_SQL,
        f"""both_versions AS (SELECT {columns}, "ArrDelay", "DepDelay", 'plain' AS version FROM legs
        UNION ALL SELECT {columns}, "DepDelay" AS "ArrDelay", "ArrDelay" AS "DepDelay", 'swapped' AS version FROM legs)""",
    )


def _workload_digests(spark, sf_dir):
    """Rows and digest of two workloads over growing prefixes of the months; 0 months is the whole table."""
    flights = inputs.yearly_flights(spark, sf_dir)
    out = None
    for months in (*layout.SCALES, 0):
        part = flights.where(layout.month_slice(FIRST_MONTH, months)) if months else flights
        for name, result in (
            ("daily_rate_by_origin", rates.daily_rate_by_origin(part)),
            ("inbound_leg_delay", rotation.inbound_leg_delay(part)),
        ):
            one = quality.result_digest(comparable(result)).select(
                F.lit(name).alias("workload"), F.lit(months).alias("months"), "rows", "digest"
            )
            out = one if out is None else out.unionByName(one)
    return out


def _workload_sql():
    parts = []
    for months in (*layout.SCALES, 0):
        last = FIRST_MONTH[0] * 12 + months - 1
        where = f'"Year" * 100 + "Month" <= {last // 12 * 100 + last % 12 + 1}' if months else "TRUE"
        parts.append(
            f"""SELECT 'daily_rate_by_origin' AS workload, {months} AS months, count(*) AS rows, round(coalesce(sum(n + coalesce(r, 0) + coalesce(d, 0)), 0), 3) AS digest
            FROM (SELECT count(*) AS n, round(avg("ArrDel15"), 6) AS r, round(avg("ArrDelay"), 6) AS d FROM labelled
                WHERE {where} AND "ArrDel15" IS NOT NULL GROUP BY "Origin", "FlightDate") q"""
        )
        parts.append(
            f"""SELECT 'inbound_leg_delay', {months}, count(*), round(coalesce(sum(n + coalesce(r, 0) + d), 0), 3)
            FROM (SELECT count(*) AS n, round(avg(prev), 6) AS r, count(prev) AS d FROM (SELECT lag("ArrDelay") OVER (
                PARTITION BY "Tail_Number" ORDER BY "FlightDate", "CRSDepTime", "Flight_Number_Reporting_Airline", "Origin", "Dest") AS prev
                FROM labelled WHERE {where}) w) q"""
        )
    return with_ctes(" UNION ALL ".join(parts), inputs.YEARLY_SQL)


def _diff(spark, sf_dir):
    """Two results that differ on purpose: rows of one priority are missing on the right."""
    left = inputs.monthly_facts(spark, sf_dir).select("origin", "year", "label")
    right = inputs.monthly_facts(spark, sf_dir).where("carrier <> '1-URGENT'").select("origin", "year", "label")
    return comparable(quality.result_diff(left, right))


QUERIES = {
    "typed_select": (
        _typed,
        with_ctes(
            """SELECT CAST(TRY_CAST(order_no AS INTEGER) AS DOUBLE) AS order_no, CAST(TRY_CAST(customer AS INTEGER) AS DOUBLE) AS customer,
            TRY_CAST(price AS DOUBLE) AS price, strftime(TRY_CAST(ordered AS DATE), '%Y-%m-%d') AS ordered, priority FROM raw""",
            _R,
        ),
    ),
    "cast_profile": (
        lambda spark, sf_dir: comparable(quality.cast_profile(inputs.raw_text(spark, sf_dir), inputs.RAW_TYPES)),
        with_ctes(_PROFILE_SQL, _R),
    ),
    "curate_and_reconcile": (_curated, _CURATED_SQL),
    "month_inventory": (
        _inventory,
        with_ctes(
            """SELECT year, month, CAST((year, month) IN (SELECT (year, month) FROM facts) AS INTEGER) AS present FROM expected""",
            _M,
            _EXPECTED_SQL,
        ),
    ),
    "missing_months": (
        _missing,
        with_ctes("SELECT year, month FROM expected EXCEPT SELECT year, month FROM facts", _M, _EXPECTED_SQL),
    ),
    "code_labels": (
        _codes,
        """SELECT code, coalesce(code || ' (' || n_name || ')', code) AS label, count(*) AS customers FROM
        (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE 'N' END || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code, c_nationkey
            FROM customer) c LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 GROUP BY 1, 2""",
    ),
    "result_digest": (
        _digest,
        with_ctes(
            """SELECT count(*) AS rows, round(coalesce(sum(flights + coalesce(rate, 0) + coalesce(delay, 0)), 0), 3) AS digest FROM (
            SELECT count(*) AS flights, round(avg("ArrDel15"), 6) AS rate, round(avg("ArrDelay"), 6) AS delay
            FROM legs WHERE "ArrDel15" IS NOT NULL GROUP BY "Origin", "FlightDate") q""",
            inputs.LEGS_SQL,
        ),
    ),
    "multiset_digest": (_multiset, _multiset_sql()),
    "workload_digests": (_workload_digests, _workload_sql()),
    "result_diff": (
        _diff,
        with_ctes(
            """SELECT origin, year, label, count(*) AS surplus FROM facts WHERE carrier = '1-URGENT' GROUP BY 1, 2, 3""", _M
        ),
    ),
}
