"""The leak-free model table: one row per labelled leg, nothing from after the cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.functions.calendar import day_index, is_weekend, month_index
from punctuality.functions.clock import actual_arrival, clock_minutes, local_timestamp
from punctuality.operators.rates import period_cube, rolled_rate
from punctuality.operators.rotation import inbound_features, inbound_usable, with_previous_leg
from punctuality.operators.skew import HOT_ROWS

# Columns of the model table, in order.
COLUMNS = (
    "year",
    "flight_date",
    "dep_minute_of_day",
    "dep_hour",
    "arr_minute_of_day",
    "day_of_week",
    "month",
    "is_weekend",
    "distance",
    "crs_elapsed",
    "carrier",
    "origin",
    "dest",
    "origin_prior_rate",
    "origin_prior_flights",
    "carrier_prior_rate",
    "inbound_delay",
    "inbound_known",
    "inbound_turnaround_minutes",
    "dep_delay",
    "taxi_out",
    "label",
)


def parsed(flights: DataFrame, *, period: str = "month", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename to model names and derive times. ``period`` is the grain of the priors."""
    date = F.col("FlightDate")
    dep = clock_minutes(F.col("CRSDepTime"))
    if period not in ("month", "day"):
        raise ValueError(f"period must be month or day, got {period!r}")
    number = month_index(F.col("Year"), F.col("Month")) if period == "month" else day_index(date)
    return flights.select(
        *keep,
        F.col("Year").alias("year"),
        F.col("Month").alias("month"),
        date.alias("flight_date"),
        F.col("DayOfWeek").alias("day_of_week"),
        F.col("Reporting_Airline").alias("carrier"),
        F.col("Origin").alias("origin"),
        F.col("Dest").alias("dest"),
        "Tail_Number",
        "Flight_Number_Reporting_Airline",
        F.col("Distance").alias("distance"),
        F.col("CRSElapsedTime").alias("crs_elapsed"),
        F.col("ArrDel15").alias("label"),
        "ArrDelay",
        F.col("DepDelay").alias("dep_delay"),
        F.col("TaxiOut").alias("taxi_out"),
        dep.alias("dep_minute_of_day"),
        clock_minutes(F.col("CRSArrTime")).alias("arr_minute_of_day"),
        local_timestamp(date, dep).alias("sched_dep_ts"),
        actual_arrival(date, F.col("DepTime"), F.col("ArrTime")).alias("actual_arr_ts"),
        number.alias("period"),
    )


def with_priors(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rates of the period before, by origin and by carrier.

    Both roll up from one aggregate of ``source``, whose shuffle they share. Nothing runs here
    and nothing is pinned: the adaptive planner broadcasts a roll-up by its bytes, or does not.
    """
    cube = period_cube(source.select("origin", "carrier", "period", "label"), ["origin", "carrier"], F.col("period"))
    # Shifting the small side by one turns "the period before" into an equality.
    next_period = (F.col("period") + 1).alias("period")
    by_origin = rolled_rate(cube, "origin").select(
        "origin", next_period, F.col("rate").alias("origin_prior_rate"), F.col("flights").alias("origin_prior_flights")
    )
    by_carrier = rolled_rate(cube, "carrier").select(
        "carrier", next_period, F.col("rate").alias("carrier_prior_rate")
    )
    return rows.join(by_origin, ["origin", "period"], "left").join(by_carrier, ["carrier", "period"], "left")


def model_table(
    flights: DataFrame,
    *,
    period: str = "month",
    hot_rows: int | None = HOT_ROWS,
    missing_tail: str = "alone",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Model rows from a fact table with the contract's column names.

    The window sees unlabelled legs too; they are dropped only after it. ``keep`` passes
    extra columns through, such as a row key.
    """
    rows = parsed(flights, period=period, keep=keep)
    rotated = with_previous_leg(
        rows,
        departure="sched_dep_ts",
        tiebreakers=("Flight_Number_Reporting_Airline", "origin", "dest"),
        hot_rows=hot_rows,
        missing_tail=missing_tail,
    ).where(F.col("label").isNotNull())
    departure, landed = F.col("sched_dep_ts"), F.col("prev_arr_ts")
    usable = inbound_usable(landed, departure)
    featured = rotated.withColumns(
        {
            **inbound_features(usable, F.col("prev_arr_delay"), landed, departure),
            "dep_hour": F.col("dep_minute_of_day") / 60,
            "is_weekend": is_weekend(F.col("day_of_week")),
        }
    )
    return with_priors(featured, rows).select(*keep, *COLUMNS)


def build_report(table: DataFrame, train_year: int, test_year: int) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("year") == train_year).alias("train_rows"),
        F.count_if(F.col("year") == test_year).alias("test_rows"),
        F.avg("inbound_known").alias("inbound_known_rate"),
    )
