"""Grouped rates: per period, per day, recent priors, routes, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far back serving priors look, and the fewest rows that make a route.
RECENT_DAYS = 30
MIN_ROUTE_FLIGHTS = 100


def period_rate(
    rows: DataFrame, keys: Sequence[str], period: Column, *, label: str = "label", count: str = "flights"
) -> DataFrame:
    """Mean label and labelled rows per key and period. Unlabelled rows do not count."""
    return (
        rows.where(F.col(label).isNotNull())
        .groupBy(*keys, period.alias("period"))
        .agg(F.avg(label).alias("rate"), F.count(F.lit(1)).alias(count))
    )


def period_cube(rows: DataFrame, keys: Sequence[str], period: Column, label: str = "label") -> DataFrame:
    """Label sum and count for all ``keys`` together: one scan that several rates roll up from."""
    return (
        rows.where(F.col(label).isNotNull())
        .groupBy(*keys, period.alias("period"))
        .agg(F.sum(label).alias("late"), F.count(F.lit(1)).alias("flights"))
    )


def rolled_rate(cube: DataFrame, key: str) -> DataFrame:
    late, flights = F.sum("late"), F.sum("flights")
    return cube.groupBy(key, "period").agg((late / flights).alias("rate"), flights.alias("flights"))


def daily_rate_by_origin(legs: DataFrame) -> DataFrame:
    """Flights, share late and mean delay per origin and date, labelled legs only."""
    return (
        legs.where(F.col("ArrDel15").isNotNull())
        .groupBy("Origin", "FlightDate")
        .agg(
            F.count(F.lit(1)).alias("flights"),
            F.avg("ArrDel15").alias("delay_rate"),
            F.avg("ArrDelay").alias("mean_delay"),
        )
    )


def recent_prior_rates(model_table: DataFrame, *, days: int = RECENT_DAYS) -> DataFrame:
    """Rate and rows per origin and per carrier over the last ``days`` days, in long form.

    ``year`` is the partition column: the last date is looked for in the last year only, and
    the recent rows are read from the one or two years that can hold them.
    """
    year, date = F.col("year"), F.col("flight_date")
    last_year = model_table.agg(F.max("year")).scalar()
    latest = model_table.where(year == last_year).agg(F.max("flight_date").alias("d"))
    since = latest.select(F.date_sub("d", days)).scalar()
    since_year = latest.select(F.year(F.date_sub("d", days))).scalar()
    recent = model_table.where((year >= since_year) & (date > since))
    cube = recent.groupBy("origin", "carrier").agg(
        F.sum("label").alias("late"), F.count("label").alias("labelled"), F.count(F.lit(1)).alias("flights")
    )

    def kind(name: str) -> DataFrame:
        return cube.groupBy(F.lit(name).alias("kind"), F.col(name).alias("key")).agg(
            F.try_divide(F.sum("late"), F.sum("labelled")).alias("rate"), F.sum("flights").alias("flights")
        )

    return kind("origin").unionByName(kind("carrier"))


def routes(
    legs: DataFrame,
    *,
    origin: str = "Origin",
    dest: str = "Dest",
    origin_city: str = "OriginCityName",
    dest_city: str = "DestCityName",
    distance: str = "Distance",
    elapsed: str = "CRSElapsedTime",
    min_flights: int = MIN_ROUTE_FLIGHTS,
) -> DataFrame:
    """Every route with enough flights: cities, typical distance and duration, flights.

    Equal rows are counted first, with plain hash aggregation on the map side: a route has
    few distinct whole miles and minutes, so what is shuffled, and what the exact medians
    see, does not grow with its flights.
    """
    counted = legs.groupBy(
        F.col(origin).alias("origin"),
        F.col(dest).alias("dest"),
        F.col(origin_city).alias("_from"),
        F.col(dest_city).alias("_to"),
        F.col(distance).alias("_distance"),
        F.col(elapsed).alias("_elapsed"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("origin", "dest")
        .agg(
            F.any_value(F.col("_from"), F.lit(True)).alias("origin_city"),
            F.any_value(F.col("_to"), F.lit(True)).alias("dest_city"),
            F.percentile("_distance", 0.5, F.col("n")).alias("distance"),
            F.percentile("_elapsed", 0.5, F.col("n")).alias("elapsed_minutes"),
            F.sum("n").alias("flights"),
        )
        .where(F.col("flights") >= min_flights)
        .orderBy(F.col("flights").desc(), "origin", "dest")
    )


def origin_rollup(route_table: DataFrame) -> DataFrame:
    """City and flights per origin, busiest first."""
    return (
        route_table.groupBy("origin")
        .agg(F.any_value(F.col("origin_city"), F.lit(True)).alias("city"), F.sum("flights").alias("flights"))
        .orderBy(F.col("flights").desc(), "origin")
    )


def label_profile(legs: DataFrame) -> DataFrame:
    """Rows, late rows and unlabelled rows by year, with the reason for a missing label."""
    label = F.col("ArrDel15")
    cancelled, diverted = F.col("Cancelled") == 1, F.col("Diverted") == 1
    missing = label.isNull()
    return legs.groupBy(F.col("Year").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(label == 1).alias("late"),
        F.count_if(missing).alias("unlabelled"),
        F.count_if(missing & cancelled).alias("cancelled"),
        F.count_if(missing & ~cancelled & diverted).alias("diverted"),
        F.count_if(missing & ~cancelled & ~diverted).alias("unexplained"),
        F.avg(label).alias("rate"),
    )
