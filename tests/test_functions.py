from datetime import date

from pyspark.sql import functions as F

from punctuality.functions import calendar, casts, clock, labels


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_clock_minutes(spark):
    got = column(spark, ["0000", "0830", "2359", "2400", None], "string", clock.clock_minutes(F.col("v")))
    assert got == [0, 510, 1439, 1440, None]


def test_checked_clock(spark):
    bad = ["830", "08:30", "0870", "2500", "abcd", ""]
    assert column(spark, bad, "string", clock.checked_clock_minutes(F.col("v"))) == [None] * 6
    both = ["2430", "2400", "0830"]
    assert column(spark, both, "string", clock.checked_clock_minutes(F.col("v"))) == [1470, 1440, 510]
    strict = clock.checked_clock_minutes(F.col("v"), strict_midnight=True)
    assert column(spark, both, "string", strict) == [None, 1440, 510]


def test_arrival_rolls_over_midnight(spark):
    df = spark.createDataFrame(
        [(1, date(2023, 3, 1), "2330", "0130"), (2, date(2023, 3, 2), "0400", "2400"), (3, date(2023, 3, 2), None, "0500")],
        "i int, d date, dep string, arr string",
    )
    got = df.select("i", clock.actual_arrival(F.col("d"), F.col("dep"), F.col("arr")).cast("string").alias("t"))
    assert [r.t for r in got.orderBy("i").collect()] == ["2023-03-02 01:30:00", "2023-03-03 00:00:00", None]


def test_minute_boundaries(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:50' a, TIMESTAMP_NTZ'2024-01-01 00:01:10' b")
    assert df.select(clock.minutes_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_casts(spark):
    values = ["7", "-3.00", "2.6", " 7", "abc", "", None, "1e3", "3000000000", "1d", ".5", "2147483647.5"]
    assert column(spark, values, "string", casts.to_int(F.col("v"))) == [7, -3, 3, 7, None, None, None, 1000, None, None, 1, None]
    doubles = ["1d", "-3.00", "5.", "n/a", "1e-1", " 2 "]
    assert column(spark, doubles, "string", casts.to_double(F.col("v"))) == [None, -3.0, 5.0, None, 0.1, 2.0]
    dates = ["2023-01-05", "2023-1-5", "2023", "2023-02-30", "20230105", "2023-01-05 10:00:00"]
    day = date(2023, 1, 5)
    assert column(spark, dates, "string", casts.to_date(F.col("v"))) == [day, day, None, None, None, day]


def test_holidays(spark):
    days = [date(2023, 11, 22), date(2023, 11, 23), date(2021, 6, 18), date(2020, 6, 19), date(2022, 12, 26), date(2023, 1, 2)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r.date: r for r in calendar.add_calendar_features(df).collect()}
    assert (got[days[0]].days_from_holiday, got[days[0]].near_holiday, got[days[0]].is_holiday) == (-1, 1, 0)
    assert got[days[1]].is_holiday == 1
    assert got[days[2]].is_holiday == 1  # the first Juneteenth, observed on the Friday
    assert got[days[3]].days_from_holiday == -14  # not a holiday before 2021: Independence Day on Friday 3 July
    assert got[days[4]].is_holiday == 1 and got[days[5]].is_holiday == 1


def test_holiday_distances_by_brute_force(spark):
    years = spark.createDataFrame([(y,) for y in range(2021, 2026)], "year int")
    holidays = sorted(r.holiday for r in calendar.federal_holidays(years).collect())
    assert len(holidays) == 5 * 11
    days = spark.createDataFrame([(date(2022, 1, 1),), (date(2024, 12, 31),)], "date date")
    for r in calendar.holiday_calendar(days).where("year(date) BETWEEN 2022 AND 2024").collect():
        # The earlier holiday first, so min() keeps it on a tie.
        assert r.days_from_holiday == min(((r.date - h).days for h in holidays), key=abs)


def test_weekday_numbers(spark):
    got = column(spark, [date(2024, 7, 15), date(2024, 7, 21)], "date", calendar.iso_weekday(F.col("v")))
    assert got == [1, 7]


def test_carrier_labels(spark):
    df = spark.createDataFrame([("AA",), ("dl",), ("ZZ",)], "code string")
    named = labels.with_label(df, "code", labels.carrier_names(spark), is_small=True)
    assert {r.code: r.label for r in named.collect()} == {
        "AA": "AA (American Airlines)", "dl": "dl (Delta Air Lines)", "ZZ": "ZZ",
    }


def test_arrival_clock(spark):
    df = spark.createDataFrame([(8, 375.0), (23, 90.0)], "h int, e double")
    assert [r[0] for r in df.orderBy("h").select(clock.arrival_clock(F.col("h"), F.col("e"))).collect()] == ["1415", "0030"]
