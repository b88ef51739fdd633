from datetime import date

import pytest
from pyspark.sql import functions as F

from punctuality.operators.rotation import inbound_leg_delay, tie_audit
from punctuality.operators.skew import lag_by_key
from punctuality.plans.model_table import model_table

D1, D2, D3 = date(2023, 3, 1), date(2023, 3, 2), date(2023, 3, 3)
# tail, date, planned departure, departure, arrival, delay, flight, origin, dest
LEGS = [
    ("N1", D1, "0600", "0600", "0800", 0.0, "01", "A", "B"),
    ("N1", D1, "1000", "1000", "1200", 5.0, "02", "B", "C"),
    ("N1", D1, "1359", "1359", "1600", 9.0, "03", "C", "D"),
    ("N1", D2, "1600", "1600", "1700", 1.0, "04", "D", "E"),
    ("N1", D3, "1701", "1701", "1800", 1.0, "05", "E", "F"),
    ("N2", D1, "2330", "2330", "0130", 7.0, "06", "A", "B"),
    ("N2", D2, "0400", "0400", "2400", 3.0, "07", "B", "C"),
    ("N3", D1, "0900", None, None, None, "08", "A", "B"),
    ("N3", D1, "1300", "1300", "1400", 2.0, "09", "B", "C"),
    ("N4", D1, "0700", "0700", "0800", 4.0, "10", "A", "B"),
    ("N4", D1, "0700", "0700", "0830", None, "11", "A", "B"),
    (None, D1, "0600", "0600", "0700", 1.0, "12", "A", "B"),
    (None, D1, "1100", "1100", "1200", 1.0, "13", "B", "C"),
]
SCHEMA = (
    "Tail_Number string, FlightDate date, CRSDepTime string, DepTime string, ArrTime string, ArrDelay double, "
    "Flight_Number_Reporting_Airline string, Origin string, Dest string"
)


def flights(spark, rows=LEGS):
    return spark.createDataFrame(rows, SCHEMA).select(
        "*",
        F.year("FlightDate").alias("Year"),
        F.month("FlightDate").alias("Month"),
        (F.weekday("FlightDate") + 1).alias("DayOfWeek"),
        F.lit("AA").alias("Reporting_Airline"),
        F.col("CRSDepTime").alias("CRSArrTime"),
        F.lit(100.0).alias("Distance"),
        F.lit(90.0).alias("CRSElapsedTime"),
        F.lit(0.0).alias("DepDelay"),
        F.lit(5.0).alias("TaxiOut"),
        F.when(F.col("ArrDelay").isNotNull(), (F.col("ArrDelay") >= 5).cast("double")).alias("ArrDel15"),
        F.col("Flight_Number_Reporting_Airline").alias("id"),
    )


def inbound(spark, **options):
    table = model_table(flights(spark), keep=("id",), **options)
    return {r.id: (r.inbound_known, r.inbound_delay, r.inbound_turnaround_minutes) for r in table.collect()}


EXPECTED = {
    "01": (0, None, None),
    "02": (1, 0.0, 120),  # landed exactly two hours before
    "03": (0, None, None),  # 119 minutes before
    "04": (1, 9.0, 1440),  # exactly a day
    "05": (0, None, None),  # a day and a minute
    "06": (0, None, None),
    "07": (1, 7.0, 150),  # landed the next day
    "09": (0, None, None),  # the leg before did not fly
    "10": (0, None, None),
    "12": (0, None, None),
    "13": (0, None, None),  # no tail, no inbound
}


@pytest.mark.parametrize("hot_rows", [2_000_000, 1, None])
def test_inbound_rules(spark, hot_rows):
    """With hot_rows=1 every vehicle is cut into cells; the answers must not change."""
    assert inbound(spark, hot_rows=hot_rows) == EXPECTED


def test_the_session_zone_moves_nothing(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert inbound(spark) == EXPECTED
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_tails_as_one_vehicle(spark):
    got = inbound(spark, missing_tail="group")
    assert got["13"] == (1, 1.0, 240) and {k: v for k, v in got.items() if k != "13"} == {
        k: v for k, v in EXPECTED.items() if k != "13"
    }


def test_priors_come_from_the_month_before(spark):
    rows = [
        ("N1", date(2023, 1, 5), "0600", "0600", "0800", 20.0, "01", "A", "B"),
        ("N1", date(2023, 1, 6), "0600", "0600", "0800", 0.0, "02", "A", "B"),
        ("N1", date(2023, 2, 1), "0600", "0600", "0800", 0.0, "03", "A", "B"),
        ("N1", date(2023, 4, 1), "0600", "0600", "0800", 0.0, "04", "A", "B"),
    ]
    got = {r.id: r for r in model_table(flights(spark, rows), keep=("id",)).collect()}
    assert got["01"].origin_prior_rate is None
    assert (got["03"].origin_prior_rate, got["03"].origin_prior_flights, got["03"].carrier_prior_rate) == (0.5, 2, 0.5)
    assert got["04"].origin_prior_rate is None  # March is missing: a gap month gives no prior


def test_nothing_after_the_cutoff_reaches_a_feature(spark):
    """Change every outcome from a day on: rows up to that day keep their features."""
    changed = [(*r[:4], "2359", 99.0, *r[6:]) if r[1] >= D2 and r[3] else r for r in LEGS]
    features = ["id", "inbound_known", "inbound_delay", "inbound_turnaround_minutes", "origin_prior_rate", "carrier_prior_rate"]
    early = F.col("flight_date") <= F.lit(D1)
    before, after = (
        {tuple(r) for r in model_table(flights(spark, rows), keep=("id",)).where(early).select(features).collect()}
        for rows in (LEGS, changed)
    )
    assert before and before == after


def test_hot_key_split_equals_plain_window(spark, sf_dir):
    """One key with most rows, another with few, ties, nulls in the order, and no key at all."""
    n = 3_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 == 6, None).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.when(F.col("id") % 97 != 0, F.floor(F.pow(F.col("id"), F.lit(1.3)) % 5_000)).cast("bigint").alias("t"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("tie"),
        (F.col("id") * 7).alias("v"),
    )
    options = dict(key="k", order=["t", "tie"], values={"v": "prev"}, clock="t")
    split = lag_by_key(rows, **options, hot_rows=100, rows_per_cell=20)
    plain = lag_by_key(rows, **options, hot_rows=None)
    assert split.count() == n
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
    assert split.where("k IS NULL AND prev IS NOT NULL").count() == 0


def test_leg_delay_and_ties(spark):
    r = inbound_leg_delay(flights(spark)).first()
    assert (r.rows, r.with_previous) == (11, 6)
    got = {r.stage: (r.groups, r["rows"]) for r in tie_audit(flights(spark)).collect()}
    assert got == {"scheduled time": (1, 2), "with tiebreakers": (0, 0)}


def test_period_is_checked(spark):
    with pytest.raises(ValueError):
        model_table(flights(spark), period="week")


def test_building_plans_starts_no_job(spark, sf_dir):
    from punctuality.plans import inputs
    from punctuality.plans.model_table import model_table
    from punctuality.registry import all_queries

    flights = inputs.yearly_flights(spark, sf_dir)
    spark.sparkContext.setJobGroup("lazy", "nothing should run")
    try:
        model_table(flights)
        queries = all_queries()
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
        queries["request_decisions"][0](spark, sf_dir)
        after = set(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Reading a Parquet footer for its schema is a job of one task; nothing else may run.
    tracker = spark.sparkContext.statusTracker()
    assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in before | after if tracker.getJobInfo(j))


def test_the_parser_of_clocks_is_compiled(spark, sf_dir):
    """A JVM interprets methods of more than 8000 bytes, some five times slower a row."""
    import contextlib
    import io
    import re

    from punctuality.plans import inputs
    from punctuality.plans.model_table import model_table

    told = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(told):
            model_table(inputs.yearly_flights(spark, sf_dir), keep=("row_key",)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told.getvalue())]
    assert sizes and max(sizes) < 8000
