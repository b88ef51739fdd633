"""How the TPC-H-like test tables stand in for the feed.

``legs`` has the contract's column names and comes from ``events``; ``monthly_facts``,
``daily_rows`` and ``scores`` come from the order tables. The SQL texts say the same for the
other engine. Only integer arithmetic is used, so both sides agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.contract import tag
from punctuality.functions.clock import clock_text, local_timestamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        local_timestamp(F.to_date("ts"), F.hour("ts") * 60 + F.minute("ts")).alias("dep"),
    )
    delay = F.floor("value").cast("int") - 60
    flown = F.col("event_id") % 50 != 0
    landing = F.col("dep") + F.make_dt_interval(F.lit(0), F.lit(0), 90 + delay)
    planned = F.col("dep") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(90))
    date = F.col("dep").cast("date")
    clock = lambda ts: clock_text(F.hour(ts) * 60 + F.minute(ts))
    return tag(
        e.select(
            F.year(date).alias("Year"),
            F.month(date).alias("Month"),
            (F.weekday(date) + 1).alias("DayOfWeek"),
            date.alias("FlightDate"),
            F.col("event_type").alias("Reporting_Airline"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("Flight_Number_Reporting_Airline"),
            F.col("user_id").cast("string").alias("Tail_Number"),
            F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("Origin"),
            F.concat(F.lit("A"), (F.col("event_id") % 10).cast("string")).alias("Dest"),
            F.concat(F.lit("City "), (F.col("user_id") % 10).cast("string")).alias("OriginCityName"),
            F.concat(F.lit("City "), (F.col("event_id") % 10).cast("string")).alias("DestCityName"),
            clock(F.col("dep")).alias("CRSDepTime"),
            clock(planned).alias("CRSArrTime"),
            F.when(flown, clock(F.col("dep"))).alias("DepTime"),
            F.when(flown, clock(landing)).alias("ArrTime"),
            F.lit(90.0).alias("CRSElapsedTime"),
            (100.0 * (1 + F.col("user_id") % 10) + 10 * (F.col("event_id") % 10)).alias("Distance"),
            F.when(flown, (delay - F.col("event_id") % 7).cast("double")).alias("DepDelay"),
            F.when(flown, (F.col("event_id") % 20 + 5).cast("double")).alias("TaxiOut"),
            F.when(flown, delay.cast("double")).alias("ArrDelay"),
            F.when(flown, (delay >= 15).cast("double")).alias("ArrDel15"),
            (F.col("event_id") % 100 == 0).cast("double").alias("Cancelled"),
            (F.col("event_id") % 100 == 50).cast("double").alias("Diverted"),
        )
    )


LEGS_SQL = """
timed AS (SELECT event_id, user_id, event_type, date_trunc('minute', CAST(ts AS TIMESTAMP)) AS dep,
                 CAST(floor(value) AS INTEGER) - 60 AS delay, event_id % 50 <> 0 AS flown FROM events),
legs AS (SELECT CAST(year(dep) AS INTEGER) AS "Year", CAST(month(dep) AS INTEGER) AS "Month",
    CAST(isodow(dep) AS INTEGER) AS "DayOfWeek", CAST(dep AS DATE) AS "FlightDate",
    event_type AS "Reporting_Airline", lpad(CAST(event_id AS VARCHAR), 12, '0') AS "Flight_Number_Reporting_Airline",
    CAST(user_id AS VARCHAR) AS "Tail_Number", 'A' || CAST(user_id % 10 AS VARCHAR) AS "Origin",
    'A' || CAST(event_id % 10 AS VARCHAR) AS "Dest", 'City ' || CAST(user_id % 10 AS VARCHAR) AS "OriginCityName",
    'City ' || CAST(event_id % 10 AS VARCHAR) AS "DestCityName",
    strftime(dep, '%H%M') AS "CRSDepTime", strftime(dep + INTERVAL 90 MINUTE, '%H%M') AS "CRSArrTime",
    CASE WHEN flown THEN strftime(dep, '%H%M') END AS "DepTime",
    CASE WHEN flown THEN strftime(dep + to_minutes(90 + delay), '%H%M') END AS "ArrTime",
    CAST(90 AS DOUBLE) AS "CRSElapsedTime",
    CAST(100 * (1 + user_id % 10) + 10 * (event_id % 10) AS DOUBLE) AS "Distance",
    CASE WHEN flown THEN CAST(delay - event_id % 7 AS DOUBLE) END AS "DepDelay",
    CASE WHEN flown THEN CAST(event_id % 20 + 5 AS DOUBLE) END AS "TaxiOut",
    CASE WHEN flown THEN CAST(delay AS DOUBLE) END AS "ArrDelay",
    CASE WHEN flown THEN CAST(CAST(delay >= 15 AS INTEGER) AS DOUBLE) END AS "ArrDel15",
    CAST(CAST(event_id % 100 = 0 AS INTEGER) AS DOUBLE) AS "Cancelled",
    CAST(CAST(event_id % 100 = 50 AS INTEGER) AS DOUBLE) AS "Diverted" FROM timed)"""


def monthly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several years of rows with origin, carrier, label, date, city names and a duration."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    date = F.col("o_orderdate").cast("date")
    nation = F.col("c_nationkey").cast("int")
    dest = (F.col("o_orderkey") % 25).cast("int")
    code = lambda n: F.concat(F.lit("N"), F.lpad(n.cast("string"), 2, "0"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_key"),
        date.alias("flight_date"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        code(nation).alias("origin"),
        code(dest).alias("dest"),
        F.concat(F.lit("Nation "), nation.cast("string")).alias("origin_city"),
        F.concat(F.lit("Nation "), dest.cast("string")).alias("dest_city"),
        F.col("o_orderpriority").alias("carrier"),
        (F.col("o_orderstatus") == "F").cast("double").alias("label"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("distance"),
        (F.floor(F.col("o_totalprice") / 5000) + 30).cast("double").alias("elapsed"),
    )


MONTHLY_SQL = """
facts AS (SELECT o_orderkey AS row_key, CAST(o_orderdate AS DATE) AS flight_date,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS origin,
    'N' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') AS dest,
    'Nation ' || CAST(c_nationkey AS VARCHAR) AS origin_city,
    'Nation ' || CAST(o_orderkey % 25 AS VARCHAR) AS dest_city,
    o_orderpriority AS carrier, CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS DOUBLE) AS label,
    CAST(floor(o_totalprice / 1000) AS DOUBLE) AS distance,
    CAST(floor(o_totalprice / 5000) + 30 AS DOUBLE) AS elapsed
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ten parallel daily series over seven years."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("flight_date"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("origin"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
    )


DAILY_SQL = """
day_rows AS (SELECT CAST(l_shipdate AS DATE) AS flight_date, 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS origin,
    CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) AS label FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored sets over the same rows: one with heavy ties, one with few."""
    label = (F.col("l_returnflag") == "R").cast("double").alias("label")
    both = F.inline(
        F.array(
            F.struct(F.lit("tied").alias("model"), (F.col("l_quantity") / 50.0).alias("prob")),
            F.struct(F.lit("fine").alias("model"), (F.col("l_extendedprice") / 200000.0).alias("prob")),
        )
    )
    return table(spark, sf_dir, "lineitem").select(label, both)


SCORES_SQL = """
raw_scores AS (SELECT 'tied' AS model, l_quantity / 50.0 AS prob, l_returnflag FROM lineitem
    UNION ALL SELECT 'fine', l_extendedprice / 200000.0, l_returnflag FROM lineitem),
scored AS (SELECT model, prob, CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) AS label FROM raw_scores)"""


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as untyped text with planted values that do not parse or need rounding."""
    key = F.col("o_orderkey")
    text = lambda c: F.col(c).cast("string")
    whole = F.floor(F.col("o_totalprice")).cast("bigint").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 97 == 0, F.lit("abc")).when(key % 97 == 1, F.lit("")).otherwise(text("o_orderkey")).alias("order_no"),
        F.when(key % 97 == 2, F.lit("-3.00")).when(key % 97 == 3, F.lit("2.6"))
        .when(key % 97 == 4, F.lit("3000000000")).when(key % 97 == 5, F.lit(" 7")).otherwise(text("o_custkey")).alias("customer"),
        F.when(key % 97 == 6, F.lit("n/a")).when(key % 97 == 7, F.lit(None).cast("string"))
        .when(key % 97 == 8, F.lit("1d")).otherwise(whole).alias("price"),
        F.when(key % 97 == 9, F.lit("2023")).when(key % 97 == 10, F.lit("1997-02-30"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ordered"),
        F.col("o_orderpriority").alias("priority"),
    )


RAW_TYPES = {"order_no": "int", "customer": "int", "price": "double", "ordered": "date", "priority": "string"}

RAW_SQL = """
raw AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'abc' WHEN o_orderkey % 97 = 1 THEN ''
        ELSE CAST(o_orderkey AS VARCHAR) END AS order_no,
    CASE WHEN o_orderkey % 97 = 2 THEN '-3.00' WHEN o_orderkey % 97 = 3 THEN '2.6'
        WHEN o_orderkey % 97 = 4 THEN '3000000000' WHEN o_orderkey % 97 = 5 THEN ' 7'
        ELSE CAST(o_custkey AS VARCHAR) END AS customer,
    CASE WHEN o_orderkey % 97 = 6 THEN 'n/a' WHEN o_orderkey % 97 = 7 THEN NULL WHEN o_orderkey % 97 = 8 THEN '1d'
        ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
    CASE WHEN o_orderkey % 97 = 9 THEN '2023' WHEN o_orderkey % 97 = 10 THEN '1997-02-30'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ordered,
    o_orderpriority AS priority FROM orders)"""


def yearly_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of legs from ``orders``, with a delay that partly follows the features."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    key, customer, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    month, minute = F.month(date), (key % 24) * 60 + key % 60
    peak = F.when(month.isin(6, 7, 12), 20).otherwise(0)
    delay = (key * 7919 % 97 - 60 + 4 * (customer % 10) + peak).cast("int")
    flown = key % 50 != 0
    # Clocks come from minutes, not from timestamps: the parser that reads them again is compiled into
    # the same method, and a JVM interprets methods of more than 8000 bytes.
    clock = lambda after: clock_text(minute + after)
    place = lambda n: F.concat(F.lit("N"), F.lpad(n.cast("string"), 2, "0"))
    return tag(
        o.select(
            key.alias("row_key"),
            F.year(date).alias("Year"),
            month.alias("Month"),
            (F.weekday(date) + 1).alias("DayOfWeek"),
            date.alias("FlightDate"),
            F.concat(F.lit("C"), F.substring("o_orderpriority", 1, 1)).alias("Reporting_Airline"),
            F.lpad(key.cast("string"), 12, "0").alias("Flight_Number_Reporting_Airline"),
            F.concat(F.lit("T"), (customer % 200).cast("string")).alias("Tail_Number"),
            place(customer % 25).alias("Origin"),
            place(key % 25).alias("Dest"),
            F.concat(F.lit("City "), (customer % 25).cast("string")).alias("OriginCityName"),
            F.concat(F.lit("City "), (key % 25).cast("string")).alias("DestCityName"),
            clock(0).alias("CRSDepTime"),
            clock(90).alias("CRSArrTime"),
            F.when(flown, clock(0)).alias("DepTime"),
            F.when(flown, clock(90 + delay)).alias("ArrTime"),
            F.lit(90.0).alias("CRSElapsedTime"),
            (100.0 * (1 + customer % 10) + 10 * (key % 10)).alias("Distance"),
            F.when(flown, (delay - key % 7).cast("double")).alias("DepDelay"),
            F.when(flown, (key % 20 + 5).cast("double")).alias("TaxiOut"),
            F.when(flown, delay.cast("double")).alias("ArrDelay"),
            F.when(flown, (delay >= 15).cast("double")).alias("ArrDel15"),
        )
    )


YEARLY_SQL = """
flights AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS "Year", CAST(month(o_orderdate) AS INTEGER) AS "Month",
    CAST(o_orderdate AS DATE) AS "FlightDate", 'N' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS "Origin",
    'N' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') AS "Dest", 'T' || CAST(o_custkey % 200 AS VARCHAR) AS "Tail_Number",
    lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS "Flight_Number_Reporting_Airline",
    lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS "CRSDepTime",
    CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderkey * 7919 % 97 - 60 + 4 * (o_custkey % 10)
        + CASE WHEN month(o_orderdate) IN (6, 7, 12) THEN 20 ELSE 0 END AS DOUBLE) END AS "ArrDelay" FROM orders),
labelled AS (SELECT *, CAST(CAST("ArrDelay" >= 15 AS INTEGER) AS DOUBLE) AS "ArrDel15" FROM flights)"""
