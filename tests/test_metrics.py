import math
import random

import pytest
from pyspark.sql import functions as F

from punctuality.operators import quality
from punctuality.operators import scoring_metrics as sm
from punctuality.plans.train import decision_report


def scored(spark, pairs, model="m"):
    return spark.createDataFrame([(model, float(y), float(p)) for y, p in pairs], "model string, label double, prob double")


def brute_ap(pairs):
    total, ap, seen_pos, seen = sum(y for y, _ in pairs), 0.0, 0, 0
    for s in sorted({p for _, p in pairs}, reverse=True):
        here = [y for y, p in pairs if p == s]
        seen, seen_pos = seen + len(here), seen_pos + sum(here)
        ap += sum(here) / total * seen_pos / seen
    return ap


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("levels", [4, 30, 10**6])
def test_ranking_metrics_by_brute_force(spark, levels):
    rng = random.Random(levels)
    pairs = [(int(rng.random() < 0.3), rng.randrange(levels) / levels) for _ in range(300)]
    # Neighbouring doubles land in one cell and must still be told apart.
    pairs += [(1, 0.5), (0, math.nextafter(0.5, 1)), (1, math.nextafter(0.5, 0))]
    got = sm.evaluate(scored(spark, pairs)).first()
    assert got.pr_auc == pytest.approx(brute_ap(pairs), abs=1e-12)
    assert got.roc_auc == pytest.approx(brute_auc(pairs), abs=1e-12)
    assert got.brier == pytest.approx(sum((p - y) ** 2 for y, p in pairs) / len(pairs), abs=1e-12)


def test_constant_and_perfect(spark):
    constant = sm.evaluate(scored(spark, [(i % 5 == 0, 0.2) for i in range(2_000)])).first()
    assert constant.pr_auc == pytest.approx(0.2) and constant.roc_auc == 0.5
    assert constant.lift_over_base_rate == pytest.approx(1.0)
    perfect = sm.evaluate(scored(spark, [(1, 0.95), (1, 0.95), (0, 0.55), (0, 0.55)])).first()
    assert perfect.pr_auc == 1.0 and perfect.roc_auc == 1.0 and perfect.max_calibration_gap > 0.4


def test_one_class_only(spark):
    late = sm.evaluate(scored(spark, [(1, 0.9), (1, 0.2)])).first()
    assert (late.pr_auc, late.roc_auc, late.positive_rate) == (1.0, None, 1.0)
    never = sm.evaluate(scored(spark, [(0, 0.9), (0, 0.2)])).first()
    assert (never.pr_auc, never.roc_auc, never.lift_over_base_rate) == (None, None, None)


def test_several_models_at_once(spark):
    a, b = [(1, 0.9), (0, 0.1)], [(1, 0.1), (0, 0.9)]
    both = scored(spark, a, "a").union(scored(spark, b, "b"))
    assert {r.model: r.roc_auc for r in sm.evaluate(both).collect()} == {"a": 1.0, "b": 0.0}


def test_bin_edges_are_the_stepped_doubles(spark):
    probs = [0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.6000000000000001, 0.7, 0.9, 1.0]
    want = [1, 2, 2, 3, 5, 6, 6, 9, 9]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    assert [r[0] for r in df.orderBy("p").select(sm._bin(F.col("p"), sm.bin_edges())).collect()] == want


def test_calibration_table(spark):
    rows = sm.calibration(sm.score_histogram(scored(spark, [(0, 0.05), (0, 0.05), (1, 0.95), (1, 0.95)]))).collect()
    assert sorted((r.bin, r["count"], r.observed_rate) for r in rows) == [(0, 2, 0.0), (9, 2, 1.0)]
    gap = sm.calibration(sm.score_histogram(scored(spark, [(0, 0.95), (1, 0.95), (0, 0.95), (1, 0.95)]))).first().gap
    assert gap == pytest.approx(0.45)
    assert sm.calibration(sm.score_histogram(scored(spark, [(1, 1.0), (1, 1.0)]))).first().bin == 9


def test_operating_points(spark):
    four = scored(spark, [(1, 0.9), (1, 0.4), (0, 0.3), (0, 0.1)])
    points = {r.threshold: r for r in sm.operating_points(four, thresholds=(0.2, 0.4, 0.41, 0.99)).collect()}
    assert (points[0.4].true_positive, points[0.4].false_positive, points[0.4].recall) == (2, 0, 1.0)  # inclusive
    assert points[0.41].recall == 0.5 and points[0.2].precision == pytest.approx(2 / 3)
    none = points[0.99]
    assert (none.precision, none.recall, none.f1, none.alert_rate, none.predicted_positive) == (0, 0, 0, 0, 0)
    for p in points.values():
        assert p.true_positive + p.false_positive + p.false_negative + p.true_negative == 4


def test_cost_optimum_prefers_low_threshold_on_ties_and_falls_with_cost(spark):
    rng = random.Random(1)
    pairs = [(int(rng.random() < p), p) for p in (rng.random() for _ in range(2_000))]
    points, best = decision_report(scored(spark, pairs))
    chosen = [r.threshold for r in best.orderBy("cost_ratio").collect()]
    assert chosen == sorted(chosen, reverse=True)
    assert points.count() == len(sm.THRESHOLDS)
    flat = sm.cost_optimum(sm.operating_points(scored(spark, [(1, 0.9), (0, 0.05)])))
    assert {r.threshold for r in flat.collect()} == {0.1}


def test_ranking_preserved(spark):
    def preserved(rows):
        df = spark.createDataFrame(rows, "b double, a double")
        return sm.ranking_preserved(df, "b", "a").first().preserved

    assert not preserved([(0.1, 0.9), (0.5, 0.5), (0.9, 0.1)])
    assert preserved([(0.1, 0.2), (0.5, 0.2), (0.9, 0.2)])
    assert preserved([(0.5, 0.2), (0.5, 0.1), (0.9, 0.3)])  # equal inputs have no order
    assert not preserved([(0.5, 0.2), (math.nextafter(0.5, 1), 0.1)])  # inside one cell


def test_missing_probability_is_an_error(spark):
    for bad in (None, float("nan")):
        rows = spark.createDataFrame([("m", 1.0, 0.5), ("m", 0.0, bad)], "model string, label double, prob double")
        with pytest.raises(Exception, match="null or NaN"):
            sm.evaluate(rows).collect()


def test_unlabelled_rows_are_left_out(spark):
    rows = spark.createDataFrame(
        [("m", 1.0, 0.9), ("m", 0.0, 0.2), ("m", None, 0.95), ("m", None, None)], "model string, label double, prob double"
    )
    got = sm.evaluate(rows).first()
    assert (got.n, got.pr_auc, got.positive_rate) == (2, 1.0, 0.5)
    assert [r.false_positive for r in sm.operating_points(rows, [], [0.9]).collect()] == [0]


def test_evaluate_without_keys(spark):
    got = sm.evaluate(scored(spark, [(1, 0.9), (0, 0.2), (0, 0.9)]), []).collect()
    assert len(got) == 1 and "_all" not in got[0] and got[0].n == 3


def test_tiny_scores_fall_into_many_cells(spark):
    rows = spark.range(20_000).select(
        (F.col("id") % 7 == 0).cast("double").alias("label"), (F.col("id") / 20_000 * 1e-6).alias("prob")
    )
    histogram = sm.celled(sm.score_histogram(rows), [])
    sizes = [r["count"] for r in histogram.groupBy("_cell").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == parts and max(sizes) < 2 * 20_000 / parts
    falls = histogram.orderBy("score").select("_cell").collect()
    assert all(a[0] <= b[0] for a, b in zip(falls, falls[1:]))
    assert sm.celled(histogram, []) is histogram  # written once


def test_ranking_over_keys_of_very_different_sizes(spark):
    """Against sums over the sorted scores, with one key that spans cells and keys inside one cell."""
    pick = random.Random(3)
    rows = [(k, float(pick.random() < 0.3), pick.choice([pick.random(), round(pick.random(), 1)])) for k, n in [("big", 3000), *[(f"s{i}", i) for i in range(1, 9)]] for _ in range(n)]
    got = {r.model: (r.pr_auc, r.roc_auc) for r in sm.ranking(sm.score_histogram(spark.createDataFrame(rows, "model string, label double, prob double"), ["model"]), ["model"]).collect()}
    assert len(got) == 9
    for key, (pr, roc) in got.items():
        own = [(p, y) for k, y, p in rows if k == key]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        if not pos:
            assert pr is None
            continue
        want = sum(sum(q >= p for q in pos) / sum(q >= p for q, _ in own) for p in pos) / len(pos)
        assert math.isclose(pr, want, rel_tol=1e-9)
        if neg and len({p for p, _ in own}) > 1:
            assert math.isclose(roc, sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg), rel_tol=1e-9)


def test_multiset_digest(spark):
    rows = [(1, 0.5, "a|b"), (1, 0.5, "a|b"), (2, None, None), (3, float("nan"), "")]
    schema = "n int, x double, s string"
    of = lambda rows, schema=schema: quality.multiset_digest(spark.createDataFrame(rows, schema)).first()
    plain = of(rows)
    assert plain.rows == 4 and of(rows[::-1]) == plain
    assert quality.multiset_digest(spark.createDataFrame(rows, schema).repartition(7).select("s", "x", "n")).first() == plain
    others = [
        rows[:3], rows + rows[:2], [*rows[:3], (3, None, "")], [*rows[:3], (3, float("nan"), None)],
        [(2, 0.5, "a|b"), (1, 0.5, "a|b"), (1, None, None), rows[3]], [(1, 0.500002, "a|b"), *rows[1:]],
    ]
    assert len({of(r).digest for r in [rows, *others]}) == 7
    assert of([(1, 2)], "a int, b int").digest != of([(2, 1)], "a int, b int").digest  # a swap between columns
    assert tuple(of([], schema)) == (0, "0-0")
    keyed = quality.multiset_digest(spark.createDataFrame(rows, schema), ["n"]).collect()
    assert sorted((r.n, r.rows) for r in keyed) == [(1, 2), (2, 1), (3, 1)]
