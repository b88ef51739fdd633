"""Queries over scored rows: ranking, calibration, thresholds, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuality.operators import scoring_metrics as sm
from punctuality.plans import inputs
from punctuality.registry.shared import comparable, with_ctes

_S = inputs.SCORES_SQL
_KEYS = ["model"]
_CLIPPED = "least(greatest(prob, 1e-15), 1 - 1e-15)"

HIST_SQL = f"""
hist AS (SELECT model, {_CLIPPED} AS s, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM hist
    WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT model, sum(pos) AS p, sum(n) - sum(pos) AS q, count(*) AS k FROM hist GROUP BY 1),
ranked AS (SELECT c.model, sum(CAST(pos AS DOUBLE) * cp / cn) / any_value(p) AS pr_auc,
    CASE WHEN any_value(k) = 1 THEN 0.5 ELSE sum(CAST(pos AS DOUBLE) * ((q - (cn - cp)) + (n - pos) / 2.0))
        / (CAST(any_value(p) AS DOUBLE) * any_value(q)) END AS roc_auc
    FROM cum c JOIN tot t ON t.model = c.model GROUP BY 1)"""

_EDGES = "[" + ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in sm.bin_edges()) + "]"
_BOUNDS = "[" + ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in [0.0, *sm.bin_edges(), 1.0]) + "]"
BINS_SQL = f"""
binned AS (SELECT model, CAST(len(list_filter({_EDGES}, lambda e: e <= s)) AS INTEGER) AS bin, n, pos, s FROM hist),
bins AS (SELECT model, bin, CAST(sum(n) AS BIGINT) AS count, sum(s * n) / sum(n) AS mean_predicted,
    CAST(sum(pos) AS DOUBLE) / sum(n) AS observed_rate FROM binned GROUP BY 1, 2)"""

_T = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in sm.THRESHOLDS)
POINTS_SQL = f"""
cuts AS (SELECT unnest([{_T}]) AS threshold),
counts AS (SELECT model, threshold, count(*) FILTER (WHERE prob >= threshold) AS predicted_positive,
    count(*) FILTER (WHERE prob >= threshold AND label = 1) AS true_positive,
    count(*) FILTER (WHERE prob >= threshold AND label <> 1) AS false_positive,
    count(*) FILTER (WHERE prob < threshold AND label = 1) AS false_negative,
    count(*) FILTER (WHERE prob < threshold AND label <> 1) AS true_negative
    FROM scored, cuts GROUP BY 1, 2),
rated AS (SELECT *, CASE WHEN predicted_positive > 0 THEN true_positive / predicted_positive ELSE 0 END AS precision,
    CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) ELSE 0 END AS recall,
    predicted_positive / (predicted_positive + true_negative + false_negative) AS alert_rate FROM counts),
points AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rated)"""

_R = ", ".join(f"CAST({r!r} AS DOUBLE)" for r in sm.COST_RATIOS)


def _scores(spark, sf_dir):
    return inputs.scores(spark, sf_dir)


def _calibration(spark, sf_dir):
    return comparable(sm.calibration(sm.score_histogram(_scores(spark, sf_dir), _KEYS), _KEYS))


def _optimum(spark, sf_dir):
    return comparable(sm.cost_optimum(sm.operating_points(_scores(spark, sf_dir), _KEYS), _KEYS))


def _remapped(spark, sf_dir):
    """One map that keeps the order (with ties) and one that does not."""
    after = F.inline(
        F.array(
            F.struct(F.lit("steps").alias("map"), (F.floor(F.col("prob") * 10) / 10).alias("after")),
            F.struct(F.lit("folded").alias("map"), F.abs(F.col("prob") - 0.5).alias("after")),
        )
    )
    return _scores(spark, sf_dir).select("model", F.col("prob").alias("before"), after)


def _preserved(spark, sf_dir):
    return comparable(sm.ranking_preserved(_remapped(spark, sf_dir), "before", "after", ["model", "map"]))


QUERIES = {
    "average_precision": (
        lambda spark, sf_dir: comparable(sm.average_precision(_scores(spark, sf_dir), _KEYS), 9),
        with_ctes("SELECT model, round(pr_auc, 9) AS pr_auc FROM ranked", _S, HIST_SQL),
    ),
    "roc_auc": (
        lambda spark, sf_dir: comparable(sm.roc_auc(_scores(spark, sf_dir), _KEYS), 9),
        with_ctes("SELECT model, round(roc_auc, 9) AS roc_auc FROM ranked", _S, HIST_SQL),
    ),
    "calibration_table": (
        _calibration,
        with_ctes(
            f"""SELECT model, bin, count, round(mean_predicted, 6) AS mean_predicted, round(observed_rate, 6) AS observed_rate,
            round(({_BOUNDS})[bin + 1], 6) AS lower, round(({_BOUNDS})[bin + 2], 6) AS upper,
            round(mean_predicted - observed_rate, 6) AS gap FROM bins""",
            _S,
            HIST_SQL,
            BINS_SQL,
        ),
    ),
    "evaluation_metrics": (
        lambda spark, sf_dir: comparable(sm.evaluate(_scores(spark, sf_dir), _KEYS)),
        with_ctes(
            f"""SELECT r.model, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier,
            round(log_loss, 6) AS log_loss, round(positive_rate, 6) AS positive_rate, n,
            round(max_calibration_gap, 6) AS max_calibration_gap, round(pr_auc / positive_rate, 6) AS lift_over_base_rate
            FROM ranked r JOIN (SELECT model, avg(({_CLIPPED} - label) * ({_CLIPPED} - label)) AS brier,
                avg(-(label * ln({_CLIPPED}) + (1 - label) * ln(1 - {_CLIPPED}))) AS log_loss, avg(label) AS positive_rate,
                count(*) AS n FROM scored GROUP BY 1) l ON l.model = r.model
            JOIN (SELECT model, max(abs(mean_predicted - observed_rate)) AS max_calibration_gap FROM bins GROUP BY 1) g
                ON g.model = r.model""",
            _S,
            HIST_SQL,
            BINS_SQL,
        ),
    ),
    "operating_points": (
        lambda spark, sf_dir: comparable(sm.operating_points(_scores(spark, sf_dir), _KEYS)),
        with_ctes(
            """SELECT model, threshold, predicted_positive, true_positive, false_positive, false_negative, true_negative,
            round(precision, 6) AS precision, round(recall, 6) AS recall, round(alert_rate, 6) AS alert_rate,
            round(f1, 6) AS f1 FROM points""",
            _S,
            POINTS_SQL,
        ),
    ),
    "cost_optimum": (
        _optimum,
        with_ctes(
            f"""SELECT model, cost_ratio, round(cost, 6) AS expected_cost, threshold, round(precision, 6) AS precision,
            round(recall, 6) AS recall, round(alert_rate, 6) AS alert_rate FROM (
                SELECT *, row_number() OVER (PARTITION BY model, cost_ratio ORDER BY cost, threshold) AS rn FROM (
                    SELECT p.*, r.cost_ratio, (false_positive + r.cost_ratio * false_negative)
                        / (true_positive + false_positive + false_negative + true_negative) AS cost
                    FROM points p, (SELECT unnest([{_R}]) AS cost_ratio) r) q) z WHERE rn = 1""",
            _S,
            POINTS_SQL,
        ),
    ),
    "ranking_preserved": (
        _preserved,
        with_ctes(
            """SELECT model, map, CAST(count(*) FILTER (WHERE low < prev - 1e-12) = 0 AS INTEGER) AS preserved,
            count(*) FILTER (WHERE low < prev - 1e-12) AS reversals FROM (SELECT *, lag(high) OVER
                (PARTITION BY model, map ORDER BY before) AS prev FROM spans) q GROUP BY 1, 2""",
            _S,
            """maps AS (SELECT model, prob AS before, 'steps' AS map, floor(prob * 10) / 10 AS after FROM scored
                UNION ALL SELECT model, prob, 'folded', abs(prob - 0.5) FROM scored)""",
            "spans AS (SELECT model, map, before, min(after) AS low, max(after) AS high FROM maps GROUP BY 1, 2, 3)",
        ),
    ),
}
