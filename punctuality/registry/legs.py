"""Queries over legs: rotation, model table and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuality.functions.calendar import day_index
from punctuality.functions.clock import actual_arrival, clock_minutes, local_timestamp
from punctuality.operators import rates, rotation
from punctuality.plans import inputs
from punctuality.plans.model_table import build_report, model_table
from punctuality.registry.shared import comparable, with_ctes

# The same rows as SQL. Priors are by day, since the test legs cover one month.
MODEL_SQL = """
parsed AS (SELECT *, CAST(substr("CRSDepTime", 1, 2) AS INTEGER) * 60 + CAST(substr("CRSDepTime", 3, 2) AS INTEGER) AS dep_min,
    CAST(substr("CRSArrTime", 1, 2) AS INTEGER) * 60 + CAST(substr("CRSArrTime", 3, 2) AS INTEGER) AS arr_min,
    CAST(substr("ArrTime", 1, 2) AS INTEGER) * 60 + CAST(substr("ArrTime", 3, 2) AS INTEGER) AS landed_min,
    date_diff('day', DATE '1970-01-01', "FlightDate") AS period FROM legs),
times AS (SELECT *, CAST("FlightDate" AS TIMESTAMP) + to_minutes(dep_min) AS dep_ts,
    CASE WHEN "ArrTime" IS NOT NULL AND "DepTime" IS NOT NULL THEN CAST("FlightDate" AS TIMESTAMP)
        + to_minutes(landed_min + CASE WHEN "ArrTime" < "DepTime" THEN 1440 ELSE 0 END) END AS arr_ts FROM parsed),
turned AS (SELECT *, lag(arr_ts) OVER w AS prev_ts, lag("ArrDelay") OVER w AS prev_delay FROM times
    WINDOW w AS (PARTITION BY "Tail_Number" ORDER BY dep_ts, "Flight_Number_Reporting_Airline", "Origin", "Dest")),
flagged AS (SELECT *, coalesce(prev_ts <= dep_ts - INTERVAL 2 HOUR AND prev_ts >= dep_ts - INTERVAL 24 HOUR, FALSE) AS usable
    FROM turned WHERE "ArrDel15" IS NOT NULL),
by_origin AS (SELECT "Origin" AS k, period + 1 AS p, avg("ArrDel15") AS rate, count(*) AS n FROM parsed
    WHERE "ArrDel15" IS NOT NULL GROUP BY 1, 2),
by_carrier AS (SELECT "Reporting_Airline" AS k, period + 1 AS p, avg("ArrDel15") AS rate FROM parsed
    WHERE "ArrDel15" IS NOT NULL GROUP BY 1, 2),
model_table AS (SELECT f."Flight_Number_Reporting_Airline" AS row_key, "Year" AS year, "FlightDate" AS flight_date,
    dep_min AS dep_minute_of_day, dep_min / 60 AS dep_hour, arr_min AS arr_minute_of_day, "DayOfWeek" AS day_of_week,
    "Month" AS month, CAST("DayOfWeek" IN (6, 7) AS INTEGER) AS is_weekend, "Distance" AS distance,
    "CRSElapsedTime" AS crs_elapsed, "Reporting_Airline" AS carrier, "Origin" AS origin, "Dest" AS dest,
    o.rate AS origin_prior_rate, CAST(o.n AS DOUBLE) AS origin_prior_flights, c.rate AS carrier_prior_rate,
    CASE WHEN usable THEN prev_delay END AS inbound_delay, CAST(usable AS INTEGER) AS inbound_known,
    CASE WHEN usable THEN CAST(date_diff('minute', prev_ts, dep_ts) AS DOUBLE) END AS inbound_turnaround_minutes,
    "DepDelay" AS dep_delay, "TaxiOut" AS taxi_out, "ArrDel15" AS label
    FROM flagged f LEFT JOIN by_origin o ON o.k = f."Origin" AND o.p = f.period
    LEFT JOIN by_carrier c ON c.k = f."Reporting_Airline" AND c.p = f.period)"""

MODEL_CTES = (inputs.LEGS_SQL, MODEL_SQL)


def legs_model_table(spark, sf_dir):
    legs = inputs.legs(spark, sf_dir).withColumn("row_key", F.col("Flight_Number_Reporting_Airline"))
    return model_table(legs, period="day", keep=("row_key",))


def _model_table(spark, sf_dir):
    df = legs_model_table(spark, sf_dir)
    nullable = {c: F.col(c).cast("double") for c in ("origin_prior_flights", "inbound_turnaround_minutes")}
    return comparable(df.withColumns(nullable))


def _bucket_report(spark, sf_dir):
    return comparable(rotation.inbound_bucket_report(legs_model_table(spark, sf_dir)))


def _build_report(spark, sf_dir):
    return comparable(build_report(legs_model_table(spark, sf_dir), 2023, 2024))


def _inbound_leg_delay(spark, sf_dir):
    return comparable(rotation.inbound_leg_delay(inputs.legs(spark, sf_dir)))


def _tie_audit(spark, sf_dir):
    return rotation.tie_audit(inputs.legs(spark, sf_dir))


def _daily_rate(spark, sf_dir):
    return comparable(rates.daily_rate_by_origin(inputs.legs(spark, sf_dir)))


def _label_profile(spark, sf_dir):
    return comparable(rates.label_profile(inputs.legs(spark, sf_dir)))


def _period_rate(key, column):
    def run(spark, sf_dir):
        rows = inputs.legs(spark, sf_dir).select(
            F.col(column).alias(key), F.col("ArrDel15").alias("label"), "FlightDate"
        )
        return comparable(rates.period_rate(rows, [key], day_index(F.col("FlightDate"))))

    sql = with_ctes(
        f"""SELECT "{column}" AS {key}, CAST(date_diff('day', DATE '1970-01-01', "FlightDate") AS INTEGER) AS period,
        round(avg("ArrDel15"), 6) AS rate, count(*) AS flights FROM legs WHERE "ArrDel15" IS NOT NULL GROUP BY 1, 2""",
        inputs.LEGS_SQL,
    )
    return run, sql


def _clocks(spark, sf_dir):
    """Distinct clock pairs with their minutes and landing times."""
    date = F.col("FlightDate")
    legs = inputs.legs(spark, sf_dir)
    return comparable(
        legs.select(
            F.col("Flight_Number_Reporting_Airline").alias("row_key"),
            clock_minutes(F.col("CRSDepTime")).alias("dep_minutes"),
            local_timestamp(date, clock_minutes(F.col("CRSArrTime"))).alias("planned_arrival"),
            actual_arrival(date, F.col("DepTime"), F.col("ArrTime")).alias("landed"),
        )
    )


_DATES = "strftime(flight_date, '%Y-%m-%d') AS flight_date"
_ROUNDED = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("dep_hour", "origin_prior_rate", "carrier_prior_rate")
)

_BUCKET_SQL = (
    f"CASE WHEN inbound_delay IS NULL THEN '{rotation.UNKNOWN_INBOUND}' "
    + "".join(f"WHEN inbound_delay <= {most} THEN '{name}' " for name, most in rotation.INBOUND_LIMITS.items())
    + f"ELSE '{rotation.LATEST_INBOUND}' END"
)

QUERIES = {
    "model_table": (
        _model_table,
        with_ctes(
            f"SELECT * REPLACE ({_DATES}, {_ROUNDED}) FROM model_table",
            *MODEL_CTES,
        ),
    ),
    "inbound_bucket_report": (
        _bucket_report,
        with_ctes(
            f"""SELECT {_BUCKET_SQL} AS bucket,
            count(*) AS flights, round(100.0 * avg(label), 2) AS pct_delayed FROM model_table GROUP BY 1 ORDER BY 3, 1""",
            *MODEL_CTES,
        ),
    ),
    "build_report": (
        _build_report,
        with_ctes(
            """SELECT count(*) AS rows, count(*) FILTER (WHERE year = 2023) AS train_rows,
            count(*) FILTER (WHERE year = 2024) AS test_rows, round(avg(inbound_known), 6) AS inbound_known_rate
            FROM model_table""",
            *MODEL_CTES,
        ),
    ),
    "inbound_leg_delay": (
        _inbound_leg_delay,
        with_ctes(
            """SELECT count(*) AS rows, round(avg(prev), 6) AS mean_prev_delay, count(prev) AS with_previous FROM (
            SELECT lag("ArrDelay") OVER (PARTITION BY "Tail_Number" ORDER BY "FlightDate", "CRSDepTime",
                "Flight_Number_Reporting_Airline", "Origin", "Dest") AS prev FROM legs WHERE "Tail_Number" IS NOT NULL) t""",
            inputs.LEGS_SQL,
        ),
    ),
    "tie_audit": (
        _tie_audit,
        with_ctes(
            """SELECT * FROM (WITH a AS (SELECT count(*) AS n FROM legs WHERE "Tail_Number" IS NOT NULL
                GROUP BY "Tail_Number", "FlightDate", "CRSDepTime" HAVING count(*) > 1),
            b AS (SELECT count(*) AS n FROM legs WHERE "Tail_Number" IS NOT NULL GROUP BY "Tail_Number", "FlightDate",
                "CRSDepTime", "Flight_Number_Reporting_Airline", "Origin", "Dest" HAVING count(*) > 1)
            SELECT 'scheduled time' AS stage, count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM a
            UNION ALL SELECT 'with tiebreakers', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM b) u""",
            inputs.LEGS_SQL,
        ),
    ),
    "daily_rate_by_origin": (
        _daily_rate,
        with_ctes(
            """SELECT "Origin", strftime("FlightDate", '%Y-%m-%d') AS "FlightDate", count(*) AS flights,
            round(avg("ArrDel15"), 6) AS delay_rate, round(avg("ArrDelay"), 6) AS mean_delay
            FROM legs WHERE "ArrDel15" IS NOT NULL GROUP BY 1, 2""",
            inputs.LEGS_SQL,
        ),
    ),
    "label_profile": (
        _label_profile,
        with_ctes(
            """SELECT "Year" AS year, count(*) AS rows, count(*) FILTER (WHERE "ArrDel15" = 1) AS late,
            count(*) FILTER (WHERE "ArrDel15" IS NULL) AS unlabelled,
            count(*) FILTER (WHERE "ArrDel15" IS NULL AND "Cancelled" = 1) AS cancelled,
            count(*) FILTER (WHERE "ArrDel15" IS NULL AND "Cancelled" <> 1 AND "Diverted" = 1) AS diverted,
            count(*) FILTER (WHERE "ArrDel15" IS NULL AND "Cancelled" <> 1 AND "Diverted" <> 1) AS unexplained,
            round(avg("ArrDel15"), 6) AS rate FROM legs GROUP BY 1""",
            inputs.LEGS_SQL,
        ),
    ),
    "origin_period_rate": _period_rate("origin", "Origin"),
    "carrier_period_rate": _period_rate("carrier", "Reporting_Airline"),
    "leg_clocks": (
        _clocks,
        with_ctes(
            """SELECT "Flight_Number_Reporting_Airline" AS row_key, dep_min AS dep_minutes,
            strftime(CAST("FlightDate" AS TIMESTAMP) + to_minutes(arr_min), '%Y-%m-%d %H:%M') AS planned_arrival,
            strftime(arr_ts, '%Y-%m-%d %H:%M') AS landed FROM times""",
            *MODEL_CTES,
        ),
    ),
}
