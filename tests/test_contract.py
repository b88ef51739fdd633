import pytest

from punctuality import contract as c
from punctuality.contract import ARRIVED, DEPARTED, LABEL, SCHEDULED, FLIGHTS

AFTER_THE_FACT = {
    "WheelsOn", "TaxiIn", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrivalDelayGroups", "ActualElapsedTime",
    "AirTime", "Cancelled", "CancellationCode", "Diverted", "CarrierDelay", "WeatherDelay", "NASDelay",
    "SecurityDelay", "LateAircraftDelay",
}


def test_counts_by_stage():
    n = {s: len(c.columns_available_at(FLIGHTS, s)) for s in c.STAGES}
    assert n == {SCHEDULED: 26, DEPARTED: 7, ARRIVED: 16, LABEL: 1}
    assert len(FLIGHTS.fields) == len(set(FLIGHTS.names)) == 50


def test_arrived_is_the_after_the_fact_list_and_never_a_feature():
    assert set(c.columns_available_at(FLIGHTS, ARRIVED)) == AFTER_THE_FACT
    assert not AFTER_THE_FACT & set(c.columns_available_at(FLIGHTS, SCHEDULED, DEPARTED))
    for features in c.SCENARIOS.values():
        c.check_features(features)
    with pytest.raises(ValueError, match="ArrDelay"):
        c.check_features(["origin", "ArrDelay"])


def test_scenarios_and_types():
    assert len(c.FEATURES_BEFORE_DEPARTURE) == 13
    assert set(c.FEATURES_AFTER_DEPARTURE) - set(c.FEATURES_BEFORE_DEPARTURE) == {"dep_delay", "taxi_out"}
    for clock in ("CRSDepTime", "CRSArrTime", "DepTime", "ArrTime", "WheelsOff", "WheelsOn"):
        assert FLIGHTS[clock].dataType.simpleString() == "string"
    kinds = [f.dataType.simpleString() for f in FLIGHTS.fields]
    assert [kinds.count(k) for k in ("string", "int", "double", "date")] == [18, 9, 22, 1]


def test_tags_survive_parquet(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "Origin string, TaxiOut double, ArrDelay double")
    c.tag(df).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert c.columns_available_at(back, SCHEDULED, DEPARTED) == ["Origin", "TaxiOut"]


def test_feature_drift_is_an_error(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, a int, k int")
    assert c.in_training_order(df, ["a", "b"], keep=["k"]).columns == ["k", "a", "b"]
    with pytest.raises(ValueError, match="'z'. are absent, .'b'. were not there"):
        c.in_training_order(df, ["a", "z"], keep=["k"])


def test_unknown_stage():
    with pytest.raises(ValueError):
        c.columns_available_at(FLIGHTS, "later")
