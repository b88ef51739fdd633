import random
from collections import Counter
from datetime import date, datetime, timedelta

from punctuality.streaming import scoring
from punctuality.streaming.priors import recent_rates_stream, requests_with_recent_rate
from punctuality.streaming.rotation import previous_leg_stream

LEGS = (
    "Tail_Number string, FlightDate date, CRSDepTime string, Flight_Number_Reporting_Airline string, "
    "Origin string, Dest string, ArrDelay double, _at string"
)
NAMES = [c.split()[0] for c in LEGS.split(", ")][:-1]
DAY = date(2024, 1, 1)


def feed(spark, folder, waves, schema, answers):
    """Waves run one by one from the same checkpoint; the rows that left, and when."""
    arrived, out, state = (str(folder / n) for n in ("in", "out", "state"))
    left = []
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(arrived)
        stream = scoring.request_stream(spark, arrived, spark.createDataFrame([], schema).schema)
        scoring.run_available(answers(stream), out, state)
        left.append(spark.read.parquet(out).count())
    return spark.read.parquet(out), left


def in_batch(legs):
    """Delay of the leg before, by sorting each tail's legs."""
    found = Counter()
    last = {}
    for leg in sorted(legs, key=lambda x: (x[1], x[2] is not None, x[2] or "", *x[3:6], x[6] is not None, x[6] or 0.0)):
        found[(*leg[:7], last.get(leg[0]))] += 1
        last[leg[0]] = leg[6]
    return found


def test_previous_leg_whatever_the_order_of_arrival(spark, tmp_path):
    pick = random.Random(4)
    legs = []
    for k in range(300):
        clock = pick.choice([None, "0000", "2400", f"{pick.randrange(24):02d}{pick.randrange(60):02d}"])
        tail = pick.choice(["T1", "T1", "T2", "T3", "", None])
        legs.append((tail, DAY + timedelta(pick.randrange(12)), clock, f"F{pick.randrange(40)}", None if k % 9 == 0 else "A", "B", pick.choice([None, 5.0, -3.25, float(k)]), "x"))
    legs = [leg for leg in legs if leg[4] is not None] + [("T9", DAY, "0900", "F", "A", "B", 1.0, "x")] * 2  # equal rows
    arrival = sorted(legs, key=lambda x: (x[1] - DAY).days + pick.random() * 0.99)
    size = len(arrival) // 3 + 1
    waves = [arrival[a : a + size] for a in range(0, len(arrival), size)]
    for wave in waves:
        pick.shuffle(wave)
    closing = [("end", DAY + timedelta(20), "0000", "F", "A", "B", None, "x")]
    got, left = feed(spark, tmp_path, [*waves, closing], LEGS, previous_leg_stream)
    assert 0 < left[0] < left[1] < left[2] < left[3]  # legs leave as time passes, not at the end
    named = [leg for leg in legs if leg[0] is not None]
    rows = Counter(tuple(r) for r in got.select(*NAMES, "prev_arr_delay").collect())
    assert rows == in_batch(named)  # an empty tail is a name


def test_a_leg_behind_the_watermark_is_dropped(spark, tmp_path):
    leg = lambda day, delay: ("T", DAY + timedelta(day), "1200", "F", "A", "B", delay, "x")
    got, _ = feed(spark, tmp_path, [[leg(0, 1.0), leg(9, 2.0)], [leg(3, 3.0)], [leg(30, 4.0)]], LEGS, previous_leg_stream)
    assert sorted((r.ArrDelay, r.prev_arr_delay) for r in got.collect()) == [(1.0, None), (2.0, 1.0)]


FACTS = "origin string, carrier string, flight_date date, label double"


def test_windows_of_recent_rates(spark, tmp_path):
    pick = random.Random(5)
    facts = [(pick.choice(["A", "B", None]), pick.choice("xy"), DAY + timedelta(pick.randrange(50)), pick.choice([0.0, 1.0, None])) for _ in range(600)]
    facts.append(("A", "x", None, 1.0))
    got, _ = feed(spark, tmp_path, [facts, [("end", "end", DAY + timedelta(60), None)]], FACTS, lambda s: recent_rates_stream(s, days=7))
    found = {(r.kind, r.key, (r.through - DAY).days): (r.rate, r.flights) for r in got.collect()}
    for through in (0, 6, 30, 49):
        for kind, at in (("origin", 0), ("carrier", 1)):
            for key in {f[at] for f in facts}:
                own = [f for f in facts if f[at] == key and f[2] and through - 7 < (f[2] - DAY).days <= through]
                said = [f[3] for f in own if f[3] is not None]
                if own:
                    assert found[(kind, key, through)] == (sum(said) / len(said) if said else None, len(own))
    assert got.groupBy("kind", "key", "through").count().where("count > 1").isEmpty()


def test_requests_meet_the_rate_of_the_day_before(spark, tmp_path):
    facts = [("A", "x", DAY + timedelta(d), float(d % 2)) for d in range(6)] + [("end", "end", DAY + timedelta(40), None)]
    asked = [(k, "A" if k < 6 else "Z", datetime(2024, 1, 1 + k % 6, 8)) for k in range(8)] + [(99, "end", datetime(2024, 2, 10))]
    for name, rows, schema in (("facts", facts, FACTS), ("asked", asked, "row int, origin string, asked_at timestamp")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda n: scoring.request_stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema)
    rates = recent_rates_stream(read("facts"), days=2)
    scoring.run_available(requests_with_recent_rate(read("asked"), rates), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.row: r.origin_prior_rate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: None, 1: 0.0, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.5, 6: None, 7: None}


def test_vehicles_share_states(spark, tmp_path):
    """Many vehicles of few legs are few states, and keep their own order."""
    legs = [(f"T{t}", DAY + timedelta(d), "0900", "F", "A", "B", float(10 * t + d), "x") for t in range(300) for d in (0, 1)]
    closing = [("end", DAY + timedelta(20), "0000", "F", "A", "B", None, "x")]
    got, _ = feed(spark, tmp_path, [legs, closing], LEGS, lambda s: previous_leg_stream(s, buckets=7))
    assert Counter(tuple(r) for r in got.select(*NAMES, "prev_arr_delay").collect()) == in_batch(legs)
    assert spark.read.format("statestore").load(str(tmp_path / "state")).count() <= 8
