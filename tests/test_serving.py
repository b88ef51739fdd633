from datetime import date

import pytest
from pyspark.sql import functions as F

from punctuality.contract import FEATURES_BEFORE_DEPARTURE
from punctuality.operators import requests as r
from punctuality.streaming import scoring

GOOD = dict(
    flight_date=date(2024, 7, 15), carrier="aa", origin="JFK", dest="lax", scheduled_departure="0830",
    scheduled_arrival="1145", distance_miles=2475.0, scheduled_elapsed_minutes=375.0, inbound_delay_minutes=None,
    inbound_turnaround_minutes=None, threshold=None,
)
PRIORS = [
    ("origin", "JFK", 0.3, 10), ("origin", "LAX", 0.28, 20), ("carrier", "AA", 0.2, 30),
    ("origin", "AS", 0.11, 5), ("carrier", "AS", 0.99, 5),
]


def requests(spark, *changes):
    rows = [tuple({**GOOD, **c}.values()) for c in changes]
    return spark.createDataFrame(rows, r.REQUEST_SCHEMA)


def priors(spark):
    return spark.createDataFrame(PRIORS, "kind string, key string, rate double, flights bigint")


def test_features_are_the_training_features(spark):
    df = r.request_features(requests(spark, {}), *r.split_priors(priors(spark)))
    assert df.columns == list(FEATURES_BEFORE_DEPARTURE)
    row = df.first()
    assert (row.day_of_week, row.month, row.dep_minute_of_day, row.arr_minute_of_day) == (1, 7, 510, 705)
    assert (row.carrier, row.dest, row.origin_prior_rate, row.carrier_prior_rate) == ("AA", "LAX", 0.3, 0.2)
    assert row.inbound_delay is None


def test_unknown_codes_and_kinds(spark):
    df = r.request_features(requests(spark, {"origin": "ZZZ"}, {"origin": "AS", "carrier": "AS"}), *r.split_priors(priors(spark)))
    got = {row.origin: (row.origin_prior_rate, row.carrier_prior_rate) for row in df.collect()}
    assert got == {"ZZZ": (None, 0.2), "AS": (0.11, 0.99)}


@pytest.mark.parametrize(
    ("field", "value"),
    [
        ("carrier", "A"), ("carrier", "TOOLONG"), ("origin", "JF"), ("dest", None), ("scheduled_departure", "830"),
        ("scheduled_departure", "2570"), ("scheduled_arrival", "08:30"), ("distance_miles", 0.0),
        ("scheduled_elapsed_minutes", -1.0), ("inbound_turnaround_minutes", -5.0), ("threshold", 1.5),
        ("flight_date", None),
    ],
)
def test_each_rule(spark, field, value):
    good, bad = r.good_and_bad(requests(spark, {field: value}, {}))
    assert [row.violations for row in bad.collect()] == [[field]]
    assert good.count() == 1


def test_decision(spark):
    df = requests(spark, {}, {"threshold": 0.5}, {"inbound_delay_minutes": 20.0})
    rows = scoring.score_requests(df, priors(spark), scoring.prior_predictor(0.2)).collect()
    assert sorted((x.threshold, x.warn, x.inbound_known) for x in rows) == [
        (0.25, True, False), (0.25, True, True), (0.5, False, False),
    ]
    assert {x.times_base_rate for x in rows} == {round(0.3 / 0.2056, 2)}


def test_stream_answers_each_request_once(spark, tmp_path):
    arrived, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = requests(spark, {"distance_miles": 1.0}, {"distance_miles": 2.0}, {"carrier": "TOOLONG"})
    first.write.parquet(arrived)
    for _ in range(2):  # the second run finds nothing new
        stream = scoring.request_stream(spark, arrived, first.schema)
        scoring.run_available(scoring.score_requests(stream, priors(spark), scoring.prior_predictor(0.2)), out, state)
    assert spark.read.parquet(out).count() == 2
    requests(spark, {"distance_miles": 3.0}).write.mode("append").parquet(arrived)
    stream = scoring.request_stream(spark, arrived, first.schema)
    scoring.run_available(scoring.score_requests(stream, priors(spark), scoring.prior_predictor(0.2)), out, state)
    assert spark.read.parquet(out).select(F.sum("distance")).first()[0] == 6.0


def test_a_trigger_does_not_read_the_facts_again(spark, sf_dir, monkeypatch):
    from punctuality.registry import serving

    read, scored = [], serving.scoring.score_requests
    monkeypatch.setattr(serving.scoring, "score_requests", lambda rows, priors, *x, **y: read.extend(priors.inputFiles()) or scored(rows, priors, *x, **y))
    assert serving._stream(spark, sf_dir).count() > 0
    assert read and not any("orders.parquet" in f for f in read)
