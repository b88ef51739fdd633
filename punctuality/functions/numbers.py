"""Guards and small decisions on numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clip, and the base rate quoted beside a served probability.
PROBABILITY_FLOOR = 1e-15
SERVED_BASE_RATE = 0.2056


def or_base_rate(prior: Column, base_rate: Column) -> Column:
    return F.coalesce(prior, base_rate)


def within(x: Column, low: float, high: float) -> Column:
    """``x`` moved into [low, high]; null and NaN stay what they are."""
    inside = F.greatest(F.least(x, F.lit(high)), F.lit(low))
    return F.when(x.isNotNull() & ~F.isnan(x), inside).otherwise(x)


def clip_probability(p: Column) -> Column:
    return within(p, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)


def sound_probability(p: Column) -> Column:
    """``p``, or an error where it is null or NaN: such a score has no rank and no loss."""
    return F.when(p.isNull() | F.isnan(p), F.raise_error(F.lit("a probability is null or NaN"))).otherwise(p)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def warning(probability: Column, threshold: Column) -> Column:
    return probability >= threshold


def times_base_rate(probability: Column, base_rate: float = SERVED_BASE_RATE) -> Column:
    return F.round(probability / F.lit(base_rate), 2)
