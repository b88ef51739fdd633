"""The vehicle's leg before this one, on a stream of legs that arrive out of order."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from punctuality.functions.calendar import day_index
from punctuality.functions.clock import clock_minutes
from punctuality.operators.rotation import TIEBREAKERS

#: How much later than the latest departure seen a leg may still arrive.
LATENESS = "2 days"
_NAMES = ("FlightDate", "CRSDepTime", *TIEBREAKERS)
_OUT = "Tail_Number string, FlightDate date, CRSDepTime string, " + ", ".join(f"{c} string" for c in TIEBREAKERS)
_OUT += ", ArrDelay double, prev_arr_delay double"
_STATE = "last string, waiting string"
#: States of the stream. A state costs some milliseconds a trigger, however few legs it gets, so
#: vehicles share one.
BUCKETS = 512


def departure_time(date: str = "FlightDate", clock: str = "CRSDepTime"):
    """Event time of a leg as TIMESTAMP, whatever the session's zone; midnight without a clock.

    It never falls along the order of a vehicle's legs (date, clock with nulls first).
    """
    minutes = day_index(F.col(date)).cast("bigint") * 1440 + F.coalesce(clock_minutes(F.col(clock)), F.lit(0))
    return F.timestamp_seconds(minutes * 60)


def _order(leg: list) -> tuple:
    """Place of a leg (date, clock, tiebreakers, delay) among its vehicle's of one time."""
    return leg[0], *[(v is not None, v or "") for v in leg[1:-1]], (leg[-1] is not None, leg[-1] or 0.0)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Legs that the watermark has passed leave in order, each with the delay of its vehicle's one before."""
    last, waiting = (json.loads(text) for text in state.get) if state.exists else ({}, [])
    if not state.hasTimedOut:
        for frame in frames:
            for leg in frame[["_ms", "Tail_Number", *_NAMES, "ArrDelay"]].itertuples(index=False):
                texts = [None if v is None else str(v) for v in leg[2:-1]]
                waiting.append([int(leg[0]), leg[1], *texts, None if math.isnan(leg[-1]) else float(leg[-1])])
    mark = state.getCurrentWatermarkMs()
    final = sorted((leg for leg in waiting if leg[0] <= mark), key=lambda leg: (leg[1], leg[0], *_order(leg[2:])))
    waiting = [leg for leg in waiting if leg[0] > mark]
    before = []
    for leg in final:
        before.append(last.get(leg[1]))
        last[leg[1]] = leg[-1]
    state.update((json.dumps(last), json.dumps(waiting)))
    if waiting:
        state.setTimeoutTimestamp(min(leg[0] for leg in waiting))
    if final:
        out = pd.DataFrame([leg[1:] for leg in final], columns=["Tail_Number", *_NAMES, "ArrDelay"])
        out["FlightDate"] = pd.to_datetime(out["FlightDate"]).dt.date
        out["ArrDelay"] = out["ArrDelay"].astype(float)
        out["prev_arr_delay"] = pd.Series(before, dtype=float)
        yield out


def previous_leg_stream(legs: DataFrame, *, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Every leg with ``prev_arr_delay``, once nothing earlier of its vehicle can arrive any more.

    Rows are those of the batch window by (tail; date, clock, tiebreakers), for every order of
    arrival in which no leg comes later than ``lateness`` behind the latest departure seen; later
    ones are dropped by the watermark (Spark counts them in ``numRowsDroppedByWatermark``). A leg
    waits until the watermark passes its departure. Vehicles are dealt by hash to ``buckets``
    states; a state holds its vehicles' legs within ``lateness`` and one delay of each. Legs alike in all of the order go by their
    delay, none first, for which the batch window has no rule. Legs that name no tail or no date have no
    inbound leg and take no part; a NaN delay counts as none. Other columns are ignored.
    """
    texts = [F.col(c).cast("string").alias(c) for c in ("CRSDepTime", *TIEBREAKERS)]
    at = departure_time()
    return (
        legs.where(F.col("Tail_Number").isNotNull() & F.col("FlightDate").isNotNull())
        .select(
            F.col("Tail_Number").cast("string").alias("Tail_Number"), F.col("FlightDate").cast("date").cast("string").alias("FlightDate"),
            *texts, F.col("ArrDelay").cast("double").alias("ArrDelay"), at.alias("_at"), F.unix_millis(at).alias("_ms"),
        )
        .withColumn("_bucket", F.pmod(F.xxhash64("Tail_Number"), F.lit(buckets)))
        .withWatermark("_at", lateness)
        .groupBy("_bucket")
        .applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
