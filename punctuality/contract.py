"""The fact-table contract: names, types, and the moment each value becomes known.

The availability tag travels as field metadata, so it survives Parquet and can be asked of
any DataFrame. A feature set is a filter on the tag; nobody lists columns by hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEDULED, DEPARTED, ARRIVED, LABEL = "scheduled", "departed", "arrived", "label"
STAGES = (SCHEDULED, DEPARTED, ARRIVED, LABEL)

# Column names, order, types and stages of the public on-time feed.
_FEED = (
    ("Year", "int", SCHEDULED),
    ("Quarter", "int", SCHEDULED),
    ("Month", "int", SCHEDULED),
    ("DayofMonth", "int", SCHEDULED),
    ("DayOfWeek", "int", SCHEDULED),
    ("FlightDate", "date", SCHEDULED),
    ("Reporting_Airline", "string", SCHEDULED),
    ("DOT_ID_Reporting_Airline", "int", SCHEDULED),
    ("Flight_Number_Reporting_Airline", "string", SCHEDULED),
    ("Tail_Number", "string", SCHEDULED),
    ("OriginAirportID", "int", SCHEDULED),
    ("Origin", "string", SCHEDULED),
    ("OriginCityName", "string", SCHEDULED),
    ("OriginState", "string", SCHEDULED),
    ("DestAirportID", "int", SCHEDULED),
    ("Dest", "string", SCHEDULED),
    ("DestCityName", "string", SCHEDULED),
    ("DestState", "string", SCHEDULED),
    ("CRSDepTime", "string", SCHEDULED),
    ("DepTimeBlk", "string", SCHEDULED),
    ("CRSArrTime", "string", SCHEDULED),
    ("ArrTimeBlk", "string", SCHEDULED),
    ("CRSElapsedTime", "double", SCHEDULED),
    ("Distance", "double", SCHEDULED),
    ("DistanceGroup", "int", SCHEDULED),
    ("Flights", "double", SCHEDULED),
    ("DepTime", "string", DEPARTED),
    ("DepDelay", "double", DEPARTED),
    ("DepDelayMinutes", "double", DEPARTED),
    ("DepDel15", "double", DEPARTED),
    ("DepartureDelayGroups", "double", DEPARTED),
    ("TaxiOut", "double", DEPARTED),
    ("WheelsOff", "string", DEPARTED),
    ("WheelsOn", "string", ARRIVED),
    ("TaxiIn", "double", ARRIVED),
    ("ArrTime", "string", ARRIVED),
    ("ArrDelay", "double", ARRIVED),
    ("ArrDelayMinutes", "double", ARRIVED),
    ("ArrivalDelayGroups", "double", ARRIVED),
    ("ActualElapsedTime", "double", ARRIVED),
    ("AirTime", "double", ARRIVED),
    ("Cancelled", "double", ARRIVED),
    ("CancellationCode", "string", ARRIVED),
    ("Diverted", "double", ARRIVED),
    ("CarrierDelay", "double", ARRIVED),
    ("WeatherDelay", "double", ARRIVED),
    ("NASDelay", "double", ARRIVED),
    ("SecurityDelay", "double", ARRIVED),
    ("LateAircraftDelay", "double", ARRIVED),
    ("ArrDel15", "double", LABEL),
)

# Partition columns of the fact table, and the feature names of the two scenarios.
PARTITION_COLUMNS = ("Year", "Month")
CATEGORICAL = ("carrier", "origin", "dest")
FEATURES_BEFORE_DEPARTURE = (
    "dep_minute_of_day",
    "arr_minute_of_day",
    "day_of_week",
    "month",
    "distance",
    "crs_elapsed",
    "carrier",
    "origin",
    "dest",
    "origin_prior_rate",
    "carrier_prior_rate",
    "inbound_delay",
    "inbound_turnaround_minutes",
)
FEATURES_AFTER_DEPARTURE = (*FEATURES_BEFORE_DEPARTURE, "dep_delay", "taxi_out")
SCENARIOS = {
    "A_pre_departure": FEATURES_BEFORE_DEPARTURE,
    "B_post_departure": FEATURES_AFTER_DEPARTURE,
}

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}


FLIGHTS = T.StructType([T.StructField(name, _TYPES[kind], True, {"availability": stage}) for name, kind, stage in _FEED])


def raw_schema(header: Sequence[str]) -> T.StructType:
    """All-text schema in feed order, so that nothing is inferred and nothing shifts."""
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def columns_available_at(schema: T.StructType | DataFrame, *stages: str) -> list[str]:
    """Names of the columns whose value is known at one of ``stages``, in table order."""
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    fields = schema.schema.fields if isinstance(schema, DataFrame) else schema.fields
    return [f.name for f in fields if f.metadata.get("availability") in stages]


def tag(df: DataFrame, schema: T.StructType = FLIGHTS) -> DataFrame:
    """Attach the contract's metadata to the columns of ``df`` that it names."""
    meta = {f.name: f.metadata for f in schema.fields}
    return df.select(
        [F.col(c).alias(c, metadata=meta[c]) if c in meta else F.col(c) for c in df.columns]
    )


def check_features(features: Iterable[str], schema: T.StructType = FLIGHTS) -> None:
    """Refuse a feature list that names an outcome."""
    outcome = set(columns_available_at(schema, ARRIVED, LABEL))
    leaked = sorted(outcome & set(features))
    if leaked:
        raise ValueError(f"known only after arrival, not features: {leaked}")


def in_training_order(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns exactly as trained, or an error that names the drift.

    ``keep`` are pass-through columns (keys, labels) which are neither expected nor drift.
    """
    have = set(df.columns) - set(keep)
    missing, extra = sorted(set(features) - have), sorted(have - set(features))
    if missing or extra:
        raise ValueError(f"not the columns of the fit: {missing} are absent, {extra} were not there")
    return df.select(*keep, *features)
