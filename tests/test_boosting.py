"""Boosted trees against a plain version in numpy, row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from punctuality.operators import boosting
from punctuality.operators.boosting import BINS, MISSING, Settings, fit_many

ONE = 1 << 30
SCHEMA = "fit string, label double, a double, b double, c int, kind string, rare string"


def rows_of(seed, n, fit, regression=False):
    """Few distinct numbers, so that cuts are exact; nulls that mean something; levels."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = None if rng.random() < 0.15 else rng.randrange(40) / 4
        b = math.nan if rng.random() < 0.05 else float(rng.randrange(25))
        c, kind = rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", "z", "w", None])
        signal = (0.4 if a is None else 0.1 * a) + (kind == "y") * 0.8 - (c == 2) * 0.5 + rng.gauss(0, 0.5)
        label = signal if regression else float(signal > 0.7)
        out.append((fit, label, a, b, c, kind, f"r{rng.randrange(400)}" if rng.random() < 0.3 else "common"))
    return out


def features_of(rows):
    """Bins of all features, by the values themselves."""
    out = []
    for at in (5, 6):
        levels = {}
        for r in rows:
            if r[at] is not None:
                levels[r[at]] = levels.get(r[at], 0) + 1
        order = sorted(levels, key=lambda x: (-levels[x], x))[:254]
        out.append([order.index(r[at]) if r[at] in order else MISSING for r in rows])
    for at in (2, 3, 4):
        known = lambda x: x is not None and not math.isnan(x)
        values = sorted({float(r[at]) for r in rows if known(r[at])})
        out.append([values.index(float(r[at])) if known(r[at]) else MISSING for r in rows])
    return out, [True, True, False, False, False]


def split_of(own, bins, categories, g, h, s):
    """The best split of some rows: every feature, side of nulls and cut is tried."""
    score = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + s.penalty)
    best = None
    for f, cat in enumerate(categories):
        seen = sorted({bins[f][i] for i in own})
        if cat:
            ratio = {b: sum(g[i] for i in own if bins[f][i] == b) / (sum(h[i] for i in own if bins[f][i] == b) + s.level_smoothing) for b in seen}
            order = sorted(seen, key=lambda b: (ratio[b], b))
            sides = [set(order[:k]) for k in range(1, len(order))]
        else:
            present = [b for b in seen if b != MISSING]
            sides = [set(present[:k]) for k in range(1, len(present) + 1)]
            sides += [x | {MISSING} for x in sides] if MISSING in seen else []
        for side in sides:
            left = [i for i in own if bins[f][i] in side]
            right = [i for i in own if bins[f][i] not in side]
            if min(len(left), len(right)) < s.leaf_rows or min(sum(h[i] for i in left), sum(h[i] for i in right)) < s.leaf_hessian:
                continue
            gain = score(left) + score(right) - score(own)
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                best = gain, left, right
    return best


def plain(rows, s):
    """Predictions for the training rows."""
    bins, categories = features_of(rows)
    y = np.array([r[1] for r in rows])
    mean = y.mean()
    if s.loss == "logistic":
        raw, scale = np.full(len(y), math.log(mean / (1 - mean))), ONE
    else:
        raw, scale = np.full(len(y), mean), ONE / max(y.max() - mean, mean - y.min())
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw)) if s.loss == "logistic" else raw
        g = np.rint((p - y) * scale) / scale
        h = np.rint(p * (1 - p) * scale) / scale if s.loss == "logistic" else np.ones(len(y))
        leaves = {0: list(range(len(y)))}
        splits, made = {0: split_of(leaves[0], bins, categories, g, h, s)}, 1
        while len(leaves) < s.leaves:
            able = [(-splits[n][0], n) for n in leaves if splits[n]]
            if not able:
                break
            node = min(able)[1]
            _, *sides = splits[node]
            del leaves[node]
            for own in sides:
                leaves[made] = own
                splits[made] = split_of(own, bins, categories, g, h, s)
                made += 1
        if made == 1:
            break
        for own in leaves.values():
            raw[own] -= s.rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + s.penalty)
    return 1 / (1 + np.exp(-raw)) if s.loss == "logistic" else raw


NUMBERS, LEVELS = ["a", "b", "c"], ["kind", "rare"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", place int").repartition(parts)


@pytest.mark.parametrize("loss, cells", [("logistic", 0), ("squared", 1500)])
def test_predictions_are_the_plain_ones(spark, loss, cells, monkeypatch):
    """With all fits by jobs, and with the smaller one in a task."""
    monkeypatch.setattr(boosting, "CHECKPOINT", 2)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", cells)
    s = Settings(loss=loss, rounds=4, leaves=7, leaf_rows=10, rate=0.3, penalty=0.5)
    one, two = rows_of(1, 240, "one", loss == "squared"), rows_of(2, 200, "two", loss == "squared")
    df = frame(spark, one + two)
    model = fit_many(df, "fit", "label", NUMBERS, LEVELS, s)
    assert len(model.trees["one"]) == 4 and max(t.children.max() for t in model.trees["one"]) > 2
    got = [r["p"] for r in df.withColumn("p", model.column(F.col("fit"))).orderBy("place").collect()]
    assert got == pytest.approx(np.concatenate([plain(one, s), plain(two, s)]).tolist(), abs=1e-9)


def test_same_trees_for_any_partitioning_and_way_of_adding(spark, monkeypatch):
    rows = rows_of(4, 400, "one")
    s = Settings(rounds=4, leaf_rows=5)
    first = fit_many(frame(spark, rows, 1), "fit", "label", NUMBERS, LEVELS, s).dumps()
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "TASK_CELLS", 500)
    monkeypatch.setattr(boosting, "DIRECT_BYTES", 0)
    monkeypatch.setattr(boosting, "PACK_ROWS", 37)
    assert fit_many(frame(spark, rows[::-1], 5), "fit", "label", NUMBERS, LEVELS, s).dumps() == first


def test_nulls_and_new_levels(spark):
    """Nulls alone carry the label; a level that was never seen takes the larger side."""
    rows = [("one", float(i % 4 == 0), None if i % 4 == 0 else float(i % 7), 1.0, 1, "x", "q") for i in range(400)]
    model = fit_many(frame(spark, rows), "fit", "label", NUMBERS, LEVELS, Settings(rounds=20))
    odd = spark.createDataFrame([("one", None, None, None, None, None, None), ("one", None, 3.0, 5.0, 9, "new", "new"), ("none", None, 3.0, 5.0, 9, "x", "q")], SCHEMA)
    high, low, gone = [r["p"] for r in odd.select(model.column(F.col("fit")).alias("p")).collect()]
    assert high > 0.8 and low < 0.1 and gone is None


def test_nothing_to_split_and_nothing_to_fit(spark):
    rows = [("one", 1.0, 1.0, 1.0, 1, "x", "q")] * 50
    model = fit_many(frame(spark, rows), "fit", "label", NUMBERS, LEVELS, Settings(loss="squared"))
    assert model.trees == {"one": []} and model.starts == {"one": 1.0}
    with pytest.raises(ValueError, match="no rows"):
        fit_many(frame(spark, rows).where("label > 2"), "fit", "label", NUMBERS, LEVELS)


def test_pipeline_stage_round_trip(spark, tmp_path):
    df = frame(spark, rows_of(6, 300, "one"))
    stage = boosting.HistogramBoosting(inputCols=[*LEVELS, *NUMBERS], categories=LEVELS, settings='{"rounds": 3}')
    model = Pipeline(stages=[stage]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    told = lambda m: [tuple(r["probability"]) for r in m.transform(df).orderBy("place").collect()]
    assert told(model) == told(back) and all(abs(sum(p) - 1) < 1e-12 for p in told(back))


def test_bins_of_many_values_are_bounded(spark):
    df = spark.range(5000).select(F.lit("one").alias("fit"), (F.col("id") / 7).alias("a"))
    bins = boosting.learn_bins(df, "fit", ["a"], [])["one"]
    assert 200 < len(bins.cuts["a"]) < BINS
    import pandas as pd

    out = bins.of([pd.Series([None, -5.0, 1e9, math.nan, 300.0])])[0].tolist()
    assert out[0] == out[3] == MISSING and out[1] == 0 and out[2] == len(bins.cuts["a"]) and 0 < out[4] < out[2]


def test_the_driver_gets_splits_and_no_sums(spark, monkeypatch):
    """What a pass sends to the driver does not follow features, bins or tasks."""
    import pickle

    sent, told = [], boosting._told
    monkeypatch.setattr(boosting, "_told", lambda *x: sent.append(told(*x)) or sent[-1])
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "LEAST_CELLS", 200)
    monkeypatch.setattr(boosting, "PACK_ROWS", 50)
    fit_many(frame(spark, rows_of(4, 400, "one")), "fit", "label", NUMBERS, LEVELS, Settings(rounds=2, leaf_rows=5))
    nodes = [x for found in sent for x in found["one"].values()]
    assert len(nodes) > 10 and max(len(pickle.dumps(x)) for x in nodes) < 2000  # sums: 5 features x 6 KB


def grown(seed, rounds, leaves=31):
    """Bins of odd widths, some missing, and trees grown on them."""
    rng = np.random.default_rng(seed)
    widths, n = [255, 254, 40, 13, 7, 1], 6000
    bins = np.stack([np.where(rng.random(n) < 0.1, MISSING, rng.integers(0, w, n)) for w in widths]).astype(np.uint8)
    label = ((bins[0] > 100) ^ (bins[2] % 3 == 0) ^ (rng.random(n) < 0.2)).astype(float)
    categories = np.array([False, False, True, False, True, False])
    settings = Settings(rounds=rounds, leaves=leaves)
    return bins, label, boosting._fit_here(settings, categories, bins, label, 0.0, float(ONE))


@pytest.mark.parametrize("rounds, leaves", [(7, 31), (4, 32), (1, 2)])
def test_tables_score_as_walking_the_trees_does(rounds, leaves, monkeypatch):
    """Odd and even numbers of trees, all leaves of a word, rows in several blocks."""
    monkeypatch.setattr(boosting, "SCORED_ROWS", 1000)
    bins, label, trees = grown(1, rounds, leaves)
    assert max((t.children[:, 0] < 0).sum() for t in trees) == leaves
    walked, looked_up = np.full(len(label), 0.3), np.full(len(label), 0.3)
    for tree in trees:
        tree.add(bins, walked)
    boosting._Tables(trees, len(bins)).add(bins, looked_up)
    assert (walked == looked_up).all() and len(set(walked)) > 1


def test_trees_of_more_leaves_than_a_table_has(spark):
    rows = rows_of(8, 600, "one")
    model = fit_many(frame(spark, rows), "fit", "label", NUMBERS, LEVELS, Settings(rounds=2, leaves=40, leaf_rows=2))
    assert max(len(t.feature) for t in model.trees["one"]) > 63
    df = frame(spark, rows)
    got = [r["p"] for r in df.withColumn("p", model.column(F.col("fit"))).orderBy("place").collect()]
    assert got == pytest.approx(plain(rows, model.settings).tolist(), abs=1e-9)


def test_joint_sums_are_those_of_each_feature(monkeypatch):
    monkeypatch.setattr(boosting, "EXACT_ROWS", 700)
    monkeypatch.setattr(boosting, "JOINT_ROWS", 1000)
    bins, label, _ = grown(2, 1)
    g, h = boosting._slopes("logistic", label, np.linspace(-3, 3, len(label)), float(ONE))
    joint = boosting._Joint(bins)
    assert len(joint.groups) < len(bins) and sorted(f for group in joint.groups for f in group) == list(range(len(bins)))
    for rows in (np.arange(len(label)), np.arange(5, len(label), 3), np.arange(5, len(label), 30), np.arange(0)):
        assert (joint.sums(rows, g + 1j * h) == boosting._node_sums(rows, bins, (g, h))).all()


def test_a_fit_that_fits_in_a_task_makes_no_passes(spark, monkeypatch):
    """More cells than one task took before: 8 passes of jobs a round, at 0.3 s."""
    monkeypatch.setattr(boosting, "_told", lambda *x: pytest.fail("a job for a pass"))
    df = spark.range(0, 600_000, 1, 4).select(
        F.lit("one").alias("fit"),
        (F.xxhash64("id") % 2 == 0).cast("double").alias("label"),
        *[(F.xxhash64("id", F.lit(i)) % (10 + 30 * i)).cast("double").alias(f"x{i}") for i in range(4)],
    )
    model = fit_many(df, "fit", "label", [f"x{i}" for i in range(4)], [], Settings(rounds=2))
    assert len(model.trees["one"]) == 2 and model.bins["one"].rows * 4 > 1 << 21


def test_a_fit_of_too_many_rows_is_not_sent_to_one_task(spark, monkeypatch):
    rows = rows_of(9, 300, "one")
    s = Settings(rounds=2, leaf_rows=5)
    here = fit_many(frame(spark, rows), "fit", "label", NUMBERS, LEVELS, s).dumps()
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 299)
    monkeypatch.setattr(boosting, "_small_fits", lambda *x: pytest.fail("all rows in a task"))
    assert fit_many(frame(spark, rows), "fit", "label", NUMBERS, LEVELS, s).dumps() == here


def test_scoring_walks_no_trees_and_sends_no_tables(spark, monkeypatch):
    """Importance scores each row some forty times: a walk took ten times as long."""
    import pickle

    import pandas as pd

    rows = rows_of(10, 500, "one")
    model = fit_many(frame(spark, rows), "fit", "label", NUMBERS, LEVELS, Settings(rounds=5, leaf_rows=5))
    columns = [pd.Series([r[at] for r in rows], dtype=kind) for at, kind in ((5, object), (6, object), (2, float), (3, float), (4, float))]
    walked, bins = np.full(len(rows), model.starts["one"]), model.bins["one"].of(columns)
    for tree in model.trees["one"]:
        tree.add(bins, walked)
    sent = len(pickle.dumps(model))
    monkeypatch.setattr(boosting.Tree, "add", lambda *x: pytest.fail("a walk"))
    assert (model.raw("one", columns) == walked).all() and (model.raw("one", columns) == walked).all()
    assert len(pickle.dumps(model)) == sent
    assert (pickle.loads(pickle.dumps(model)).raw("one", columns) == walked).all()
