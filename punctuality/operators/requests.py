"""Scoring requests: which rules they break, the features they get, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.contract import FEATURES_BEFORE_DEPARTURE, in_training_order
from punctuality.functions.calendar import iso_weekday
from punctuality.functions.clock import clock_minutes, is_clock
from punctuality.functions.numbers import SERVED_BASE_RATE, times_base_rate, warning

# Default threshold and the lengths of the codes.
DEFAULT_THRESHOLD = 0.25
CARRIER_LENGTH = (2, 3)
AIRPORT_LENGTH = (3, 4)

REQUEST_SCHEMA = """
    flight_date date, carrier string, origin string, dest string, scheduled_departure string,
    scheduled_arrival string, distance_miles double, scheduled_elapsed_minutes double,
    inbound_delay_minutes double, inbound_turnaround_minutes double, threshold double
"""


def _within(length: Column, bounds: tuple[int, int]) -> Column:
    return length.between(*bounds)


def broken_rules() -> dict[str, Column]:
    """Name of each field and whether its rule is broken. A required null breaks it."""
    threshold = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    holds = {
        "flight_date": F.col("flight_date").isNotNull(),
        "carrier": _within(F.length("carrier"), CARRIER_LENGTH),
        "origin": _within(F.length("origin"), AIRPORT_LENGTH),
        "dest": _within(F.length("dest"), AIRPORT_LENGTH),
        "scheduled_departure": is_clock(F.col("scheduled_departure"), strict_midnight=True),
        "scheduled_arrival": is_clock(F.col("scheduled_arrival"), strict_midnight=True),
        "distance_miles": F.col("distance_miles") > 0,
        "scheduled_elapsed_minutes": F.col("scheduled_elapsed_minutes") > 0,
        "inbound_turnaround_minutes": F.coalesce(F.col("inbound_turnaround_minutes") >= 0, F.lit(True)),
        "threshold": threshold.between(0.0, 1.0),
    }
    return {name: ~F.coalesce(ok, F.lit(False)) for name, ok in holds.items()}


def validate(requests: DataFrame) -> DataFrame:
    """Add ``violations``, the fields whose rule is broken; empty for a good request."""
    named = [F.when(broken, F.lit(name)) for name, broken in broken_rules().items()]
    return requests.withColumn("violations", F.array_compact(F.array(*named)))


def good_and_bad(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that keep every rule, and the others with the fields whose rule they break."""
    any_broken = F.lit(False)
    for broken in broken_rules().values():
        any_broken = any_broken | broken
    return requests.where(~any_broken), validate(requests).where(F.size("violations") > 0)


def with_serving_priors(requests: DataFrame, origin_priors: DataFrame, carrier_priors: DataFrame) -> DataFrame:
    """Look both rates up; an unknown code gives null. Works on streams, the priors static."""
    return requests.join(origin_priors, "origin", "left").join(carrier_priors, "carrier", "left")


def split_priors(priors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long table as two lookups, so that an origin never meets a carrier's rate."""

    def kind(name: str) -> DataFrame:
        return priors.where(F.col("kind") == name).select(
            F.col("key").alias(name), F.col("rate").alias(f"{name}_prior_rate")
        )

    return kind("origin"), kind("carrier")


def request_features(requests: DataFrame, origin_priors: DataFrame, carrier_priors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Good requests to exactly the training features, in training order.

    The priors are (origin, origin_prior_rate) and (carrier, carrier_prior_rate).
    """
    upper = requests.withColumns({c: F.upper(c) for c in ("carrier", "origin", "dest")})
    derived = with_serving_priors(upper, origin_priors, carrier_priors).select(
        *keep,
        clock_minutes(F.col("scheduled_departure")).alias("dep_minute_of_day"),
        clock_minutes(F.col("scheduled_arrival")).alias("arr_minute_of_day"),
        iso_weekday(F.col("flight_date")).alias("day_of_week"),
        F.month("flight_date").alias("month"),
        F.col("distance_miles").alias("distance"),
        F.col("scheduled_elapsed_minutes").alias("crs_elapsed"),
        "carrier",
        "origin",
        "dest",
        "origin_prior_rate",
        "carrier_prior_rate",
        F.col("inbound_delay_minutes").alias("inbound_delay"),
        "inbound_turnaround_minutes",
    )
    return in_training_order(derived, FEATURES_BEFORE_DEPARTURE, keep)


def decide(scored: DataFrame, *, probability: str = "prob", threshold: str = "threshold") -> DataFrame:
    """The answer to each request from its probability and its own threshold."""
    p, t = F.col(probability), F.coalesce(F.col(threshold), F.lit(DEFAULT_THRESHOLD))
    return scored.withColumns(
        {
            "delay_probability": F.round(p, 4),
            "warn": warning(p, t),
            "threshold": t,
            "base_rate": F.lit(SERVED_BASE_RATE),
            "times_base_rate": times_base_rate(p),
            "inbound_known": F.col("inbound_delay").isNotNull(),
        }
    )
