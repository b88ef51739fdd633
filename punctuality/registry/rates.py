"""Queries over several years of monthly facts: priors, slices, routes, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuality.functions.calendar import month_index
from punctuality.operators import rates
from punctuality.plans import inputs
from punctuality.plans.model_table import with_priors
from punctuality.registry.shared import comparable, with_ctes

_M = inputs.MONTHLY_SQL


def _facts(spark, sf_dir):
    return inputs.monthly_facts(spark, sf_dir)


def _monthly_rate(key):
    def run(spark, sf_dir):
        return comparable(rates.period_rate(_facts(spark, sf_dir), [key], month_index(F.col("year"), F.col("month"))))

    sql = with_ctes(
        f"""SELECT {key}, year * 12 + month AS period, round(avg(label), 6) AS rate, count(*) AS flights
        FROM facts WHERE label IS NOT NULL GROUP BY 1, 2""",
        _M,
    )
    return run, sql


def _monthly_priors(spark, sf_dir):
    rows = _facts(spark, sf_dir).select(
        "row_key", "origin", "carrier", "label", month_index(F.col("year"), F.col("month")).alias("period")
    )
    out = with_priors(rows, rows).select(
        "row_key", "origin_prior_rate", F.col("origin_prior_flights").cast("double").alias("origin_prior_flights"),
        "carrier_prior_rate",
    )
    return comparable(out)


def _recent_priors(spark, sf_dir):
    return comparable(rates.recent_prior_rates(_facts(spark, sf_dir)))


#: The test routes have tens of rows where the feed's have hundreds.
TEST_ROUTE_FLIGHTS = 30


def test_routes(spark, sf_dir):
    return rates.routes(
        _facts(spark, sf_dir),
        origin="origin",
        dest="dest",
        origin_city="origin_city",
        dest_city="dest_city",
        distance="distance",
        elapsed="elapsed",
        min_flights=TEST_ROUTE_FLIGHTS,
    )


ROUTES_SQL = f"""
routes AS (SELECT origin, dest, any_value(origin_city) AS origin_city, any_value(dest_city) AS dest_city,
    median(distance) AS distance, median(elapsed) AS elapsed_minutes, count(*) AS flights
    FROM facts GROUP BY 1, 2 HAVING count(*) >= {TEST_ROUTE_FLIGHTS})"""


def _origin_rollup(spark, sf_dir):
    return rates.origin_rollup(test_routes(spark, sf_dir))


RECENT_SQL = """
recent AS (SELECT * FROM facts WHERE flight_date > (SELECT max(flight_date) FROM facts) - INTERVAL 30 DAY),
priors AS (SELECT 'origin' AS kind, origin AS key, avg(label) AS rate, count(*) AS flights FROM recent GROUP BY 1, 2
    UNION ALL SELECT 'carrier', carrier, avg(label), count(*) FROM recent GROUP BY 1, 2)"""

QUERIES = {
    "origin_month_rate": _monthly_rate("origin"),
    "carrier_month_rate": _monthly_rate("carrier"),
    "previous_month_priors": (
        _monthly_priors,
        with_ctes(
            """SELECT f.row_key, round(o.rate, 6) AS origin_prior_rate, CAST(o.n AS DOUBLE) AS origin_prior_flights,
            round(c.rate, 6) AS carrier_prior_rate FROM facts f
            LEFT JOIN by_origin o ON o.k = f.origin AND o.p = f.year * 12 + f.month - 1
            LEFT JOIN by_carrier c ON c.k = f.carrier AND c.p = f.year * 12 + f.month - 1""",
            _M,
            "by_origin AS (SELECT origin AS k, year * 12 + month AS p, avg(label) AS rate, count(*) AS n FROM facts GROUP BY 1, 2)",
            "by_carrier AS (SELECT carrier AS k, year * 12 + month AS p, avg(label) AS rate FROM facts GROUP BY 1, 2)",
        ),
    ),
    "prior_rates_recent": (
        _recent_priors,
        with_ctes("SELECT kind, key, round(rate, 6) AS rate, flights FROM priors", _M, RECENT_SQL),
    ),
    "routes": (
        lambda spark, sf_dir: comparable(test_routes(spark, sf_dir)),
        with_ctes("SELECT * FROM routes ORDER BY flights DESC, origin, dest", _M, ROUTES_SQL),
    ),
    "origin_rollup": (
        _origin_rollup,
        with_ctes(
            """SELECT origin, any_value(origin_city) AS city, CAST(sum(flights) AS BIGINT) AS flights
            FROM routes GROUP BY 1 ORDER BY 3 DESC, 1""",
            _M,
            ROUTES_SQL,
        ),
    ),
}
