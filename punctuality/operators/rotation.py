"""What the same vehicle did before: previous-leg features admitted only before a cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.functions.clock import clock_minutes, epoch_minute, minutes_between
from punctuality.functions.calendar import day_index
from punctuality.operators.skew import HOT_ROWS, lag_by_key

# Hours before departure at which the forecast is made, and the longest gap
# after which a previous leg no longer counts as the inbound one.
CUTOFF_HOURS = 2
MAX_TURNAROUND_HOURS = 24
# Total order of the legs of one vehicle after its departure time, and the names of the
# states of its inbound leg by the most minutes late.
TIEBREAKERS = ("Flight_Number_Reporting_Airline", "Origin", "Dest")
UNKNOWN_INBOUND = "inbound open"
INBOUND_LIMITS = {"inbound punctual": 0, "inbound slightly late": 15, "inbound late": 60}
LATEST_INBOUND = "inbound very late"


def with_previous_leg(
    legs: DataFrame,
    *,
    tail: str = "Tail_Number",
    departure: str = "sched_dep_ts",
    tiebreakers: Sequence[str] = TIEBREAKERS,
    arrival: str = "actual_arr_ts",
    delay: str = "ArrDelay",
    hot_rows: int | None = HOT_ROWS,
    missing_tail: str = "alone",
) -> DataFrame:
    """Add ``prev_arr_ts`` and ``prev_arr_delay`` of the vehicle's leg before this one.

    Legs without a tail never become each other's inbound; ``missing_tail="group"`` takes
    them for one vehicle instead, as a plain window does.
    """
    if missing_tail not in ("alone", "group"):
        raise ValueError(f"missing_tail must be alone or group, got {missing_tail!r}")
    key = F.col(tail) if missing_tail == "alone" else F.coalesce(F.col(tail), F.lit(""))
    return lag_by_key(
        legs.withColumns({"_minute": epoch_minute(F.col(departure)), "_tail": key}),
        "_tail",
        [departure, *tiebreakers],
        {arrival: "prev_arr_ts", delay: "prev_arr_delay"},
        "_minute",
        hot_rows=hot_rows,
    ).drop("_minute", "_tail")


def inbound_usable(
    previous_arrival: Column,
    departure: Column,
    *,
    cutoff_hours: int = CUTOFF_HOURS,
    max_hours: int = MAX_TURNAROUND_HOURS,
) -> Column:
    """Never null: landed by the cutoff, and recently enough to be the vehicle that is coming."""
    latest = departure - F.make_dt_interval(F.lit(0), F.lit(cutoff_hours))
    earliest = departure - F.make_dt_interval(F.lit(0), F.lit(max_hours))
    return F.coalesce(
        previous_arrival.isNotNull() & (previous_arrival <= latest) & (previous_arrival >= earliest),
        F.lit(False),
    )


def inbound_features(usable: Column, delay: Column, previous_arrival: Column, departure: Column) -> dict[str, Column]:
    return {
        "inbound_delay": F.when(usable, delay),
        "inbound_known": usable.cast("int"),
        "inbound_turnaround_minutes": F.when(usable, minutes_between(previous_arrival, departure)),
    }


def inbound_bucket(delay: Column) -> Column:
    named = F.when(delay.isNull(), F.lit(UNKNOWN_INBOUND))
    for name, limit in INBOUND_LIMITS.items():
        named = named.when(delay <= limit, F.lit(name))
    return named.otherwise(F.lit(LATEST_INBOUND))


def inbound_bucket_report(model_table: DataFrame) -> DataFrame:
    """Rows and share late per state of the inbound leg, least late first."""
    return (
        model_table.groupBy(inbound_bucket(F.col("inbound_delay")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("flights"), F.round(100.0 * F.avg("label"), 2).alias("pct_delayed"))
        .orderBy("pct_delayed", "bucket")
    )


def inbound_leg_delay(legs: DataFrame, *, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Legs, mean previous delay, and legs with a previous one, over legs that name a tail."""
    date, clock = "FlightDate", "CRSDepTime"
    needed = legs.where(F.col("Tail_Number").isNotNull()).select(
        "Tail_Number", date, clock, *TIEBREAKERS, "ArrDelay"
    )
    minute = day_index(F.col(date)).cast("bigint") * 1440 + F.coalesce(clock_minutes(F.col(clock)), F.lit(1439))
    return lag_by_key(
        needed.withColumn("_minute", minute),
        "Tail_Number",
        [date, clock, *TIEBREAKERS],
        {"ArrDelay": "prev"},
        "_minute",
        hot_rows=hot_rows,
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("prev").alias("mean_prev_delay"),
        F.count("prev").alias("with_previous"),
    )


def tie_audit(legs: DataFrame) -> DataFrame:
    """Groups and rows that share (tail, date, time), before and after the tiebreakers.

    The coarse groups roll up from the fine ones, so the legs are read once.
    """
    keys = ["Tail_Number", "FlightDate", "CRSDepTime"]
    fine = (
        legs.where(F.col("Tail_Number").isNotNull()).groupBy(*keys, *TIEBREAKERS).agg(F.count(F.lit(1)).alias("n"))
    )
    coarse = fine.groupBy(*keys).agg(F.sum("n").alias("n"))

    def ties(stage: str, groups: DataFrame) -> DataFrame:
        return groups.where("n > 1").agg(
            F.lit(stage).alias("stage"),
            F.count(F.lit(1)).alias("groups"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        )

    return ties("scheduled time", coarse).unionByName(ties("with tiebreakers", fine))
