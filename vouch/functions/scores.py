"""Step scores and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import clamp


def _below(value: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    out = F.when(value.isNull(), F.lit(0.0))
    for bound, score in steps:
        out = out.when(value < bound, F.lit(score))
    return out.otherwise(F.lit(beyond))


def _at_least(value: Column, steps: list[tuple[float, str]], otherwise: Column) -> Column:
    out = F
    for bound, label in steps:
        out = out.when(value >= bound, F.lit(label))
    return out.otherwise(otherwise)


def sample_size_score(n: Column) -> Column:
    return _below(n, fixed.SAMPLE_SIZE_STEPS, 1.0)


def p_value_score(p: Column) -> Column:
    return _below(p, fixed.P_VALUE_STEPS, 0.0)


def strength_score(r: Column) -> Column:
    return F.coalesce(clamp(F.abs(r)), F.lit(0.0))


def confidence_level(score: Column) -> Column:
    return _at_least(score, fixed.CONFIDENCE_LEVELS, F.lit("low"))


def correlation_label(r: Column) -> Column:
    """strong / moderate / weak, null below the weakest bound."""
    return _at_least(F.abs(r), fixed.CORRELATION_LABELS, F.lit(None).cast("string"))


def trend_label(r_squared: Column) -> Column:
    return _at_least(r_squared, fixed.TREND_LABELS, F.lit("weak"))


def outlier_magnitude(count: Column) -> Column:
    return F.when(count == 0, 0.0).when(count == 1, 0.70).when(count <= 3, 0.75).otherwise(0.80)
