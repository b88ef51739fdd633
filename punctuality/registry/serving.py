"""Queries over scoring requests: validation, features, decisions in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuality.functions.clock import arrival_clock
from punctuality.operators import rates, requests
from punctuality.operators.rotation import TIEBREAKERS
from punctuality.plans import inputs
from punctuality.registry import legs as leg_queries
from punctuality.registry import rates as rate_queries
from punctuality.registry.rates import RECENT_SQL
from punctuality.registry.shared import comparable, with_ctes
from punctuality.session import materialised, shared_folder
from punctuality.streaming import scoring
from punctuality.streaming.priors import recent_rates_stream
from punctuality.streaming.rotation import previous_leg_stream

_M = inputs.MONTHLY_SQL
BASE_RATE = 0.25


def _requests(spark, sf_dir):
    """One request per order, with planted mistakes in every field."""
    f = inputs.monthly_facts(spark, sf_dir)
    key = F.col("row_key")
    bad = lambda n: key % 31 == n
    clock = lambda h, m: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"))
    carrier = F.concat(F.when(key % 2 == 0, "c").otherwise("C"), F.substring("carrier", 1, 1))
    departure = (
        F.when(bad(0), "830").when(bad(1), "08:30").when(bad(2), "2570").when(bad(3), "abcd").when(bad(4), "2430")
        .when(bad(5), "2400").otherwise(clock(key % 24, key % 60))
    )
    return f.select(
        "row_key",
        "flight_date",
        F.when(bad(6), "TOOLONG").otherwise(carrier).alias("carrier"),
        F.when(bad(7), "X").when(bad(8), "ZZZ").otherwise(F.col("origin")).alias("origin"),
        F.when(bad(9), F.lit(None).cast("string")).otherwise(F.lower("dest")).alias("dest"),
        departure.alias("scheduled_departure"),
        F.when(bad(10), "").otherwise(clock((key + 3) % 24, key % 60)).alias("scheduled_arrival"),
        F.when(bad(11), F.lit(0.0)).otherwise(F.col("distance") + 1).alias("distance_miles"),
        F.when(bad(12), F.lit(-5.0)).otherwise(F.col("elapsed")).alias("scheduled_elapsed_minutes"),
        F.when(key % 3 == 0, (key % 90).cast("double")).alias("inbound_delay_minutes"),
        F.when(bad(13), F.lit(-1.0)).when(key % 3 == 0, (key % 600).cast("double")).alias("inbound_turnaround_minutes"),
        F.when(bad(14), F.lit(1.5)).when(key % 5 != 0, F.lit(0.3)).alias("threshold"),
    )


REQUESTS_SQL = """
requests AS (SELECT row_key, flight_date, row_key % 31 AS bad,
    CASE WHEN row_key % 31 = 6 THEN 'TOOLONG' ELSE CASE WHEN row_key % 2 = 0 THEN 'c' ELSE 'C' END || substr(carrier, 1, 1) END AS carrier,
    CASE row_key % 31 WHEN 7 THEN 'X' WHEN 8 THEN 'ZZZ' ELSE origin END AS origin,
    CASE WHEN row_key % 31 = 9 THEN NULL ELSE lower(dest) END AS dest,
    CASE row_key % 31 WHEN 0 THEN '830' WHEN 1 THEN '08:30' WHEN 2 THEN '2570' WHEN 3 THEN 'abcd' WHEN 4 THEN '2430' WHEN 5 THEN '2400'
        ELSE lpad(CAST(row_key % 24 AS VARCHAR), 2, '0') || lpad(CAST(row_key % 60 AS VARCHAR), 2, '0') END AS scheduled_departure,
    CASE WHEN row_key % 31 = 10 THEN '' ELSE lpad(CAST((row_key + 3) % 24 AS VARCHAR), 2, '0')
        || lpad(CAST(row_key % 60 AS VARCHAR), 2, '0') END AS scheduled_arrival,
    CASE WHEN row_key % 31 = 11 THEN 0.0 ELSE distance + 1 END AS distance_miles,
    CASE WHEN row_key % 31 = 12 THEN -5.0 ELSE elapsed END AS scheduled_elapsed_minutes,
    CASE WHEN row_key % 3 = 0 THEN CAST(row_key % 90 AS DOUBLE) END AS inbound_delay_minutes,
    CASE WHEN row_key % 31 = 13 THEN -1.0 WHEN row_key % 3 = 0 THEN CAST(row_key % 600 AS DOUBLE) END AS inbound_turnaround_minutes,
    CASE WHEN row_key % 31 = 14 THEN 1.5 WHEN row_key % 5 <> 0 THEN 0.3 END AS threshold FROM facts),
checked AS (SELECT *, concat_ws(',', CASE WHEN length(carrier) NOT BETWEEN 2 AND 3 THEN 'carrier' END,
    CASE WHEN length(origin) NOT BETWEEN 3 AND 4 THEN 'origin' END, CASE WHEN dest IS NULL THEN 'dest' END,
    CASE WHEN NOT regexp_full_match(scheduled_departure, '([01][0-9]|2[0-3])[0-5][0-9]|2400') THEN 'scheduled_departure' END,
    CASE WHEN NOT regexp_full_match(scheduled_arrival, '([01][0-9]|2[0-3])[0-5][0-9]|2400') THEN 'scheduled_arrival' END,
    CASE WHEN distance_miles <= 0 THEN 'distance_miles' END,
    CASE WHEN scheduled_elapsed_minutes <= 0 THEN 'scheduled_elapsed_minutes' END,
    CASE WHEN inbound_turnaround_minutes < 0 THEN 'inbound_turnaround_minutes' END,
    CASE WHEN threshold > 1 THEN 'threshold' END) AS violations FROM requests),
features AS (SELECT row_key, threshold,
    CAST(substr(scheduled_departure, 1, 2) AS INTEGER) * 60 + CAST(substr(scheduled_departure, 3, 2) AS INTEGER) AS dep_minute_of_day,
    CAST(substr(scheduled_arrival, 1, 2) AS INTEGER) * 60 + CAST(substr(scheduled_arrival, 3, 2) AS INTEGER) AS arr_minute_of_day,
    CAST(isodow(flight_date) AS INTEGER) AS day_of_week, CAST(month(flight_date) AS INTEGER) AS month, distance_miles AS distance,
    scheduled_elapsed_minutes AS crs_elapsed, upper(c.carrier) AS carrier, upper(c.origin) AS origin, upper(c.dest) AS dest,
    o.rate AS origin_prior_rate, a.rate AS carrier_prior_rate, inbound_delay_minutes AS inbound_delay, inbound_turnaround_minutes
    FROM checked c LEFT JOIN priors o ON o.kind = 'origin' AND o.key = upper(c.origin)
    LEFT JOIN priors a ON a.kind = 'carrier' AND 'C' || substr(a.key, 1, 1) = upper(c.carrier) WHERE violations = '')"""


def _priors(spark, sf_dir):
    facts = inputs.monthly_facts(spark, sf_dir)
    return rates.recent_prior_rates(facts.withColumn("carrier", F.concat(F.lit("C"), F.substring("carrier", 1, 1))))


def _validation(spark, sf_dir):
    checked = requests.validate(_requests(spark, sf_dir))
    return checked.select("row_key", F.array_join("violations", ",").alias("violations"))


def _features(spark, sf_dir):
    good, _ = requests.good_and_bad(_requests(spark, sf_dir))
    lookups = requests.split_priors(_priors(spark, sf_dir))
    return comparable(requests.request_features(good, *lookups, keep=("row_key",)))


def _answers(of):
    return of.select(
        "row_key", "delay_probability", F.col("warn").cast("int").alias("warn"), "threshold", "base_rate",
        "times_base_rate", F.col("inbound_known").cast("int").alias("inbound_known"),
    )


def _decisions(spark, sf_dir):
    scored = scoring.score_requests(
        _requests(spark, sf_dir), _priors(spark, sf_dir), scoring.prior_predictor(BASE_RATE), keep=("row_key",)
    )
    return comparable(_answers(scored))


def _stream(spark, sf_dir):
    """The same answers from a stream: requests arrive as files, each is answered once."""
    arrived, out, state = (shared_folder(spark, n) for n in ("requests", "answers", "state"))
    batch = _requests(spark, sf_dir)
    batch.write.option("maxRecordsPerFile", 5_000).parquet(arrived)
    stream = scoring.request_stream(spark, arrived, batch.schema)
    # Written once: a stream plans its static side anew for every trigger, from the facts otherwise.
    priors = materialised(_priors(spark, sf_dir), "priors")
    scored = scoring.score_requests(stream, priors, scoring.prior_predictor(BASE_RATE), keep=("row_key",))
    scoring.run_available(_answers(scored), out, state)
    return comparable(spark.read.parquet(out))


_DECISIONS_SQL = with_ctes(
    f"""SELECT row_key, round(p, 4) AS delay_probability, CAST(p >= coalesce(threshold, 0.25) AS INTEGER) AS warn,
    CAST(coalesce(threshold, 0.25) AS DOUBLE) AS threshold, CAST(0.2056 AS DOUBLE) AS base_rate,
    round(p / CAST(0.2056 AS DOUBLE), 2) AS times_base_rate, CAST(inbound_delay IS NOT NULL AS INTEGER) AS inbound_known
    FROM (SELECT *, coalesce(origin_prior_rate, CAST({BASE_RATE} AS DOUBLE)) AS p FROM features) q""",
    _M,
    RECENT_SQL,
    REQUESTS_SQL,
)


def _arrivals(spark, waves, answers, files=100_000):
    """Answers of a stream whose rows arrive wave by wave; every wave is a run from the checkpoint."""
    arrived, out, state = (shared_folder(spark, n) for n in ("arrived", "answers", "state"))
    for wave in waves:
        wave.write.mode("append").parquet(arrived)
        stream = scoring.request_stream(spark, arrived, wave.schema, files_per_trigger=files)
        scoring.run_available(answers(stream), out, state)
    return spark.read.parquet(out)


def _stream_legs(spark, sf_dir):
    """Legs in four waves, each out of order and overlapping the next by a day, then a closing leg."""
    legs = inputs.legs(spark, sf_dir).select(
        "Tail_Number", "FlightDate", "CRSDepTime", *TIEBREAKERS, F.col("ArrDelay").cast("double").alias("ArrDelay")
    )
    # A leg comes up to a day after its departure's date.
    late = F.pmod(F.xxhash64("Flight_Number_Reporting_Airline"), F.lit(2)).cast("int")
    day = F.unix_date("FlightDate") + late
    first, last = legs.agg(F.min(F.unix_date("FlightDate")), F.max(F.unix_date("FlightDate"))).first()
    wave = F.floor((day - F.lit(first)) * 4 / F.lit(last + 2 - first))
    closing = legs.limit(1).select(
        F.lit("end of feed").alias("Tail_Number"), F.date_from_unix_date(F.lit(last + 5)).alias("FlightDate"),
        *[F.col(c) for c in legs.columns[2:]],
    )
    out = _arrivals(spark, [*[legs.where(wave == k) for k in range(4)], closing], previous_leg_stream)
    return comparable(
        out.agg(
            F.count(F.lit(1)).alias("rows"), F.avg("prev_arr_delay").alias("mean_prev_delay"),
            F.count("prev_arr_delay").alias("with_previous"),
        )
    )


def _stream_recent(spark, sf_dir):
    """The windows through the last day, after a closing row has ended them."""
    facts = inputs.monthly_facts(spark, sf_dir).select("origin", "carrier", "flight_date", "label")
    last = facts.agg(F.max(F.unix_date("flight_date"))).first()[0]
    closing = facts.limit(1).select(
        F.lit("end of feed").alias("origin"), "carrier", F.date_from_unix_date(F.lit(last + 5)).alias("flight_date"), "label"
    )
    out = _arrivals(spark, [facts, closing], recent_rates_stream)
    return comparable(out.where(F.unix_date("through") == last).select("kind", "key", "rate", "flights"))


def _arrival_clocks(spark, sf_dir):
    facts = inputs.monthly_facts(spark, sf_dir)
    return facts.select("row_key", arrival_clock(F.col("row_key") % 24, F.col("elapsed")).alias("arrival"))


QUERIES = {
    "request_validation": (
        _validation,
        with_ctes("SELECT row_key, violations FROM checked", _M, RECENT_SQL, REQUESTS_SQL),
    ),
    "request_features": (
        _features,
        with_ctes(
            """SELECT * EXCLUDE (threshold) REPLACE (round(origin_prior_rate, 6) AS origin_prior_rate,
            round(carrier_prior_rate, 6) AS carrier_prior_rate) FROM features""",
            _M,
            RECENT_SQL,
            REQUESTS_SQL,
        ),
    ),
    "request_decisions": (_decisions, _DECISIONS_SQL),
    "stream_scoring": (_stream, _DECISIONS_SQL),
    "stream_inbound_leg_delay": (_stream_legs, leg_queries.QUERIES["inbound_leg_delay"][1]),
    "stream_recent_rates": (_stream_recent, rate_queries.QUERIES["prior_rates_recent"][1]),
    "arrival_clock": (
        _arrival_clocks,
        with_ctes(
            """SELECT row_key, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(row_key % 24 * 60 + elapsed AS INTEGER)), '%H%M') AS arrival
            FROM facts""",
            _M,
        ),
    ),
}
