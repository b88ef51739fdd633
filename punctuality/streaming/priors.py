"""Recent rates per origin and carrier as a stream of finished windows, joined to requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.operators.rates import RECENT_DAYS

LATENESS = "2 days"


def _day_start(date: str):
    """Midnight of a date as TIMESTAMP in UTC, the zone in which windows are cut."""
    return F.timestamp_seconds(F.unix_date(F.col(date).cast("date")).cast("bigint") * 86_400)


def recent_rates_stream(facts: DataFrame, *, days: int = RECENT_DAYS, lateness: str = LATENESS) -> DataFrame:
    """(kind, key, rate, flights, through, known_at): rates over the ``days`` days up to ``through``.

    Facts are merged to one row per day, origin and carrier; windows of ``days`` days that move by
    one are sums of those rows, so a fact enters one state, not ``days`` of them. A window leaves
    when the watermark passes its end and is then final. ``known_at`` is the last microsecond of
    its last day and carries the watermark. Facts without a date take no part.
    """
    daily = (
        facts.where(F.col("flight_date").isNotNull())
        .select("origin", "carrier", F.col("label").cast("double").alias("label"), _day_start("flight_date").alias("at"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("day"), "origin", "carrier")
        .agg(F.sum("label").alias("late"), F.count("label").alias("labelled"), F.count(F.lit(1)).alias("flights"))
    )
    kinds = F.inline(
        F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).cast("string").alias("key")) for name in ("origin", "carrier")])
    )
    return (
        daily.select(F.window_time("day").alias("at"), "late", "labelled", "flights", kinds)
        .groupBy(F.window("at", f"{days} days", "1 day").alias("span"), "kind", "key")
        .agg(F.try_divide(F.sum("late"), F.sum("labelled")).alias("rate"), F.sum("flights").alias("flights"))
        .select(
            "kind", "key", "rate", "flights",
            F.date_from_unix_date((F.unix_seconds("span.end") / 86_400 - 1).cast("int")).alias("through"),
            F.window_time("span").alias("known_at"),
        )
    )


def requests_with_recent_rate(requests: DataFrame, rates: DataFrame, *, key: str = "origin", lateness: str = LATENESS) -> DataFrame:
    """Requests of a second stream with the rate of their ``key`` through the day before.

    ``requests`` have a TIMESTAMP ``asked_at``. A request meets the window that ended within the
    24 hours before it; that bound lets Spark drop both sides' state as the watermarks move. A
    request without such a window is answered with a null rate, when none can come any more.
    """
    known = rates.where(F.col("kind") == key).select(
        F.col("key").alias("_key"), F.col("rate").alias(f"{key}_prior_rate"), "known_at"
    )
    asked = requests.withWatermark("asked_at", lateness)
    fits = F.expr("asked_at > known_at AND asked_at <= known_at + INTERVAL 1 DAY") & (F.col(key) == F.col("_key"))
    return asked.join(known, fits, "left_outer").drop("_key", "known_at")
