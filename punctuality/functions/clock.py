"""Local clock strings (``HHmm``, with ``2400`` a real value) and local timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440


def clock_minutes(clock: Column) -> Column:
    """Minutes past midnight; ``2400`` stays 1440 so that order within a day holds."""
    hours = F.substring(clock, 1, 2).try_cast("int")
    minutes = F.substring(clock, 3, 2).try_cast("int")
    return hours * 60 + minutes


# What counts as a clock. Hours up to 24 and minutes up to 59 pass, so "2430" does;
# the strict form admits hour 24 only as "2400".
_CLOCK = r"^([01][0-9]|2[0-4])[0-5][0-9]$"
_STRICT_CLOCK = r"^(([01][0-9]|2[0-3])[0-5][0-9]|2400)$"


def is_clock(clock: Column, *, strict_midnight: bool = False) -> Column:
    return clock.rlike(_STRICT_CLOCK if strict_midnight else _CLOCK)


def checked_clock_minutes(clock: Column, *, strict_midnight: bool = False) -> Column:
    """As :func:`clock_minutes`, but null for whatever is not a clock."""
    return F.when(is_clock(clock, strict_midnight=strict_midnight), clock_minutes(clock))


def clock_text(minutes: Column) -> Column:
    """Minutes past midnight to ``HHmm``, wrapping at the day's end."""
    wrapped = F.pmod(minutes.cast("int"), F.lit(MINUTES_PER_DAY))
    return F.lpad((F.floor(wrapped / 60) * 100 + wrapped % 60).cast("string"), 4, "0")


def arrival_clock(departure_hour: Column, elapsed_minutes: Column) -> Column:
    """Clock of arrival for a departure on the hour and a planned duration."""
    return clock_text(departure_hour * 60 + elapsed_minutes.cast("int"))


def local_timestamp(date: Column, minutes: Column) -> Column:
    """Date plus minutes as a zone-less timestamp; 1440 rolls to the next day."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def actual_arrival(date: Column, departure_clock: Column, arrival_clock_: Column) -> Column:
    """When the leg landed. ``date`` is the departure date, so an arrival clock below the
    departure clock means the next day. Both clocks are local, each in its own zone: a
    short westbound leg can look like a next-day arrival, and this rule keeps that."""
    next_day = F.when(arrival_clock_ < departure_clock, F.lit(1)).otherwise(F.lit(0))
    landed = local_timestamp(F.date_add(date, next_day), clock_minutes(arrival_clock_))
    return F.when(arrival_clock_.isNotNull() & departure_clock.isNotNull(), landed)


def epoch_minute(ts: Column) -> Column:
    """Whole minutes since 1970 on the local clock, without any zone conversion."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * MINUTES_PER_DAY + F.hour(ts) * 60 + F.minute(ts)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from ``start`` to ``end``, both on one local clock."""
    return epoch_minute(end) - epoch_minute(start)
