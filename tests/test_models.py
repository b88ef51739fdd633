import threading

import pytest
from pyspark.sql import functions as F

from punctuality.contract import CATEGORICAL
from punctuality.contract import FEATURES_BEFORE_DEPARTURE as FEATURES
from punctuality.operators import categories, importance, splits
from punctuality.operators import scoring_metrics as sm
from punctuality.operators.skew import hash_rank
from punctuality.plans import inputs, train
from punctuality.plans.model_table import model_table
from punctuality.session import materialised
from punctuality.sources.tables import load_bundle


@pytest.fixture(scope="module")
def table(spark):
    flights = inputs.yearly_flights(spark, "/root/testdata/sf0.01")
    return materialised(model_table(flights, keep=("row_key",)))


@pytest.fixture(scope="module")
def years(table):
    return splits.train_test(table, FEATURES, 1999, 2000, keep=("row_key",))


@pytest.fixture(scope="module")
def boosted(years):
    return train.build_gradient_boosting(FEATURES, max_iter=5).fit(years[0])


def test_rare_levels_come_from_training_rows(spark):
    def frame(**counts):
        return spark.createDataFrame([(k, k, k) for k, n in counts.items() for _ in range(n)], "origin string, dest string, carrier string")

    model = categories.RareLevels(maxLevels=2).fit(frame(ATL=100, JFK=50, XXX=2, YYY=1))
    out = model.transform(frame(ATL=1, JFK=1, XXX=1, ZZZ=10_000))
    assert {r.origin: r.n for r in out.groupBy("origin").agg(F.count("*").alias("n")).collect()} == {"ATL": 1, "JFK": 1, "OTHER": 10_001}
    share = {r.column: r.coverage for r in model.coverage(frame(ATL=3, ZZZ=1)).collect()}
    assert share == {"origin": 0.75, "dest": 0.75, "carrier": 0.75}
    assert categories.RareLevels(inputCols=["origin"], minCount=50).fit(frame(ATL=50, JFK=49)).levels() == {"origin": ["ATL"]}


def test_baselines(spark):
    fit = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (0.0,)], "label double")
    test = spark.createDataFrame([(0.0, 0.3, None), (1.0, None, 0.1)], "label double, origin_prior_rate double, carrier_prior_rate double")
    got = {(r.model, r.label): r.prob for r in train.baseline_scores(fit, test).collect()}
    assert got[("base rate", 0.0)] == got[("origin prior", 1.0)] == got[("carrier prior", 0.0)] == 0.25
    assert got[("origin prior", 0.0)] == 0.3 and got[("carrier prior", 1.0)] == 0.1


def test_exact_share_of_every_month(spark):
    rows = spark.range(1200).select("id", (F.col("id") % 12 + 1).cast("int").alias("month"))
    for fraction, each in ((0.15, 15), (0.2, 20), (0.017, 1)):
        fit, held = splits.stratified_by_month(rows, "id", fraction)
        assert {r["count"] for r in held.groupBy("month").count().collect()} == {each}
        assert fit.count() + held.count() == 1200 and fit.join(held, "id").count() == 0
    # The same rows whatever the partitioning; other rows for another seed.
    ids = lambda df, seed=0: {r.id for r in splits.stratified_by_month(df, "id", 0.15, seed)[1].collect()}
    assert ids(rows) == ids(rows.repartition(7)) != ids(rows, 1)
    for bad in (0.0, 1.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            splits.stratified_by_month(rows, "id", bad)
    with pytest.raises(KeyError):
        splits.by_month(rows.select("id"))
    early, late = splits.by_month(rows)
    assert {r.month for r in late.collect()} == {11, 12} and early.count() == 1000


def test_exact_sample_and_rank(spark):
    rows = spark.range(1000)
    assert splits.exact_sample(rows, "id", 137).count() == 137
    assert splits.exact_sample(rows, "id", 5000).count() == 1000
    ranked = hash_rank(rows, "id", 3).collect()
    assert sorted(r.position for r in ranked) == list(range(1, 1001))
    assert [r.id for r in sorted(ranked, key=lambda r: r.position)] != list(range(1000))


def test_shuffled_variants_permute_one_column(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), F.lit(0.0).alias("label"), "id", (F.col("id") * 2).alias("twice"))
    out = importance.shuffled_variants(rows, "key", ["id", "twice"], 2, 0)
    assert out.count() == 200 * 2 * 2 + 200
    swapped = out.where("feature = 'id' AND repeat = 1")
    assert sorted(r.id for r in swapped.collect()) == list(range(200))  # the same values
    assert swapped.where("twice = id * 2").count() < 20  # on other rows
    assert out.where("feature = '(none)' AND twice = id * 2").count() == 200


def test_models_beat_the_base_rate(years, boosted):
    fit, test = years
    logistic = train.build_logistic(FEATURES, rows=fit.count(), max_iter=20).fit(fit)
    base = test.agg(F.avg("label")).first()[0]
    for model in (boosted, logistic):
        scored = train.predicted(model, test)
        assert scored.count() == test.count()
        metrics = sm.evaluate(scored.withColumn("model", F.lit("m"))).first()
        assert metrics.pr_auc > 1.1 * base and metrics.roc_auc > 0.55


def test_native_nulls_do_not_cost_precision(years):
    """At equal rounds the trees rank at least as well as MLlib's with a sentinel."""
    fit, test = years
    ap = {}
    for name, build in (("own", train.build_gradient_boosting), ("mllib", train.build_mllib_boosting)):
        scored = train.predicted(build(FEATURES, max_iter=15).fit(fit), test)
        ap[name] = sm.evaluate(scored.withColumn("model", F.lit(name))).first().pr_auc
    assert ap["own"] >= ap["mllib"] - 0.005


def test_scenarios_side_by_side_are_single_fits(years, table):
    """A model fitted beside another with more features is the one fitted alone."""
    fit, test = years
    few = [f for f in FEATURES if f not in FEATURES[4:9] or f in CATEGORICAL]
    out = train.evaluate_scenarios(table, 1999, 2000, {"few": few, "all": FEATURES}, max_iter=3, logistic_iter=3)
    got = {(r.scenario, r.model): r.pr_auc for r in out.collect()}
    assert len(got) == 10
    alone = train.build_gradient_boosting(few, max_iter=3).fit(fit)
    scored = train.predicted(alone, test).withColumn("model", F.lit("m"))
    assert got["few", "gradient boosting"] == pytest.approx(sm.evaluate(scored).first().pr_auc, abs=1e-12)


def test_other_models_are_fitted_beside_the_boosted_ones(table, monkeypatch):
    """A fit of boosted models takes few tasks: it does not wait for the others."""
    begun, fit_boosted, scored_models = threading.Event(), train.fit_boosted, train.scored_models

    def first(*x, **more):
        begun.set()
        return fit_boosted(*x, **more)

    def second(*x, **more):
        assert begun.wait(60)
        return scored_models(*x, **more)

    monkeypatch.setattr(train, "fit_boosted", first)
    monkeypatch.setattr(train, "scored_models", second)
    out = train.evaluate_scenarios(table, 1999, 2000, {"all": FEATURES}, max_iter=2, logistic_iter=2)
    assert {r.model for r in out.collect()} >= {"gradient boosting", "logistic regression"}

    def failing(*x, **more):
        raise ArithmeticError("boosted")

    monkeypatch.setattr(train, "fit_boosted", failing)
    monkeypatch.setattr(train, "scored_models", scored_models)
    with pytest.raises(ArithmeticError, match="boosted"):
        train.evaluate_scenarios(table, 1999, 2000, {"all": FEATURES}, max_iter=2, logistic_iter=2)


def test_unseen_levels_and_missing_values_are_scored(years, boosted):
    _, test = years
    odd = test.limit(5).withColumns({"origin": F.lit("NEW"), "distance": F.lit(None).cast("double")})
    probs = [r.prob for r in train.predicted(boosted, odd).collect()]
    assert len(probs) == 5 and all(0 <= p <= 1 for p in probs)


def test_isotonic_keeps_order_and_fits(years, boosted):
    fit, test = years
    held = train.predicted(boosted, fit)
    isotonic = train.fit_isotonic(held)
    mapped = train.isotonic_scores(isotonic, train.predicted(boosted, test))
    assert sm.ranking_preserved(mapped, "prob", "mapped").first().preserved
    on_fit = train.isotonic_scores(isotonic, held).agg(F.avg("mapped"), F.avg("label")).first()
    assert on_fit[0] == pytest.approx(on_fit[1], abs=1e-9)
    assert mapped.where("mapped < 0 OR mapped > 1").count() == 0


def test_isotonic_points_keep_every_row(spark):
    rows = spark.range(500).select((F.col("id") % 3 == 0).cast("double").alias("label"), (F.col("id") / 500).alias("prob"))
    got = train.isotonic_points(rows).agg(F.count("*"), F.sum("weight"), F.sum(F.col("rate") * F.col("weight"))).first()
    assert tuple(got) == (500, 500.0, pytest.approx(167.0))


@pytest.mark.parametrize("n", [200, 5_000])
def test_isotonic_map_of_rare_events(spark, n):
    """Scores in [0, 0.01] get the exact monotone map, whatever their number."""
    i = F.col("id")
    rows = spark.range(n).select((F.pmod(F.xxhash64(i), F.lit(97)) < 1 + i * 20 / n).cast("double").alias("label"), (i / n / 100).alias("prob"))
    mapped = train.isotonic_scores(train.fit_isotonic(rows), rows).orderBy("prob").collect()
    blocks = []
    for r in mapped:
        blocks.append([r.label, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + size]
    wanted = [total / size for total, size in blocks for _ in range(size)]
    assert [r.mapped for r in mapped] == pytest.approx(wanted, abs=1e-9)


def test_best_model(spark):
    rows = [("A", "x", 0.2), ("A", "y", 0.4), ("B", "x", 0.9)]
    best = train.best_model(spark.createDataFrame(rows, "scenario string, model string, pr_auc double"))
    assert {r.scenario: (r.model, r.pr_auc) for r in best.collect()} == {"A": ("y", 0.4), "B": ("x", 0.9)}


def test_near_zero(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", 1e-6), ("c", -1e-6)], "feature string, mean_drop double")
    assert {r.feature for r in importance.near_zero(rows).collect()} == {"b", "c"}


def test_importance_finds_the_signal(years, boosted):
    _, test = years
    out = importance.permutation_importance(
        lambda rows: train.predicted(boosted, rows), test, "row_key", FEATURES, repeats=2, sample=1000
    ).collect()
    assert len(out) == len(FEATURES)
    assert out[0].feature in ("distance", "month", "origin") and out[0].mean_drop > 0
    assert [r.mean_drop for r in out] == sorted((r.mean_drop for r in out), reverse=True)


def test_export_round_trip(spark, table, years, tmp_path):
    routes = spark.createDataFrame([("A", "B", 1.0)], "origin string, dest string, distance double")
    meta = train.export(table, routes, str(tmp_path / "b"), FEATURES, 1999, 2000, max_iter=2).first()
    bundle = load_bundle(spark, str(tmp_path / "b"))
    assert bundle.metadata["pr_auc"] == meta.pr_auc and bundle.metadata["features"].split(",") == list(FEATURES)
    assert {r.kind for r in bundle.priors.collect()} == {"origin", "carrier"} and bundle.routes.count() == 1
    assert train.predicted(bundle.model, years[1]).count() == years[1].count()
