"""Calendar columns, period numbers, and distance to the nearest federal holiday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the calendar columns, in the order in which models take them.
CALENDAR_FEATURES = (
    "day_of_week",
    "month",
    "day_of_year",
    "is_weekend",
    "days_from_holiday",
    "is_holiday",
    "near_holiday",
)

# US federal holidays. Rules as (month, day) or (month, weekday with Monday 0, nth);
# nth -1 is the last one. Dates that fall on a weekend are observed on the nearest working day.
_FIXED = ((1, 1, 1), (6, 19, 2021), (7, 4, 1), (11, 11, 1), (12, 25, 1))  # month, day, first year
_FLOATING = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))


def month_index(year: Column, month: Column) -> Column:
    """Consecutive number of a calendar month, so that the month before is one less."""
    return year * 12 + month


def day_index(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def iso_weekday(date: Column) -> Column:
    """1 is Monday, 7 is Sunday."""
    return F.weekday(date) + 1


def is_weekend(iso_day: Column) -> Column:
    return iso_day.isin(6, 7).cast("int")


def _observed(date: Column) -> Column:
    shift = F.when(F.weekday(date) == 5, -1).when(F.weekday(date) == 6, 1).otherwise(0)
    return F.date_add(date, shift)


def _nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    if nth > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        to_first = F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7))
        return F.date_add(first, to_first + 7 * (nth - 1))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))


def federal_holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """Observed holidays of each year of ``years`` as one row per (holiday)."""
    y = F.col(year)
    fixed = [
        F.when(y >= since, _observed(F.make_date(y, F.lit(month), F.lit(day))))
        for month, day, since in _FIXED
    ]
    floating = [_nth_weekday(y, *rule) for rule in _FLOATING]
    return (
        years.select(F.explode(F.array_compact(F.array(*fixed, *floating))).alias("holiday"))
        .distinct()
    )


def holiday_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, days_from_holiday) for every day of the years of ``dates`` and one more each side.

    Built from the gaps between consecutive holidays: each gap is unfolded into its days, and
    a day takes the holiday it is nearer to, the earlier one on a tie. No pairing of dates
    with holidays takes place. The size is bounded by the calendar: 366 rows per year.
    """
    years = (
        dates.select(F.year(date).alias("y"))
        .distinct()
        .select(F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("year"))
        .distinct()
    )
    # About eleven rows per calendar year: a single window group is bounded by the calendar.
    gaps = federal_holidays(years).select(
        "holiday", F.lead("holiday").over(Window.partitionBy(F.lit(0)).orderBy("holiday")).alias("next")
    )
    days = gaps.where(F.col("next").isNotNull()).select(
        "holiday",
        "next",
        F.explode(F.sequence("holiday", F.date_sub("next", 1))).alias(date),
    )
    since, until = F.datediff(date, "holiday"), F.datediff(date, "next")
    return days.select(
        date, F.when(since <= -until, since).otherwise(until).alias("days_from_holiday")
    )


def add_calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Weekday (Monday 0), month, day of year, weekend and holiday columns."""
    # At most 366 rows for each calendar year, of which the date type has 9999.
    calendar = F.broadcast(holiday_calendar(df, date))
    offset = F.col("days_from_holiday")
    return (
        df.join(calendar, date, "left")
        .withColumns(
            {
                "day_of_week": F.weekday(date),
                "month": F.month(date),
                "day_of_year": F.dayofyear(date),
                "is_weekend": (F.weekday(date) >= 5).cast("int"),
                "is_holiday": (offset == 0).cast("int"),
                "near_holiday": (F.abs(offset) <= 3).cast("int"),
            }
        )
    )


def expected_months(spark: SparkSession, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(year, month) of every month from ``first`` to ``last``, both included."""
    start, stop = (y * 12 + m - 1 for y, m in (first, last))
    n = F.col("id")
    return spark.range(start, stop + 1).select(
        F.floor(n / 12).cast("int").alias("year"), (n % 12 + 1).cast("int").alias("month")
    )
