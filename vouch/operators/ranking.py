"""Confidence, priority score, de-duplication and ranking of verified insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import canonical, clamp
from vouch.functions.scores import (
    confidence_level,
    outlier_magnitude,
    p_value_score,
    sample_size_score,
    strength_score,
)
from vouch.operators.verify import verified_only
from vouch.session import DEAL

# --- fixed values: weights ----------------------------------------------------
CONFIDENCE_WEIGHTS = {
    "correlation": {
        "effect_strength": 0.30, "statistical_significance": 0.30, "sample_size": 0.20, "verification": 0.20,
    },
    "group_difference": {
        "effect_strength": 0.30, "statistical_significance": 0.25, "minimum_group_sample_size": 0.25,
        "verification": 0.20,
    },
    "outlier": {"deterministic_detection": 0.60, "verification": 0.40},
    "time_series_trend": {
        "trend_fit": 0.30, "change_magnitude": 0.30, "sample_size": 0.20, "verification": 0.20,
    },
}
SCORE_WEIGHTS = {
    "group_difference": {
        "magnitude": 0.30, "business_impact": 0.15, "verification": 0.20, "confidence": 0.25, "novelty": 0.10,
    },
    "correlation": {
        "statistical_strength": 0.30, "business_impact": 0.15, "verification": 0.20, "confidence": 0.25,
        "novelty": 0.10,
    },
    "outlier": {
        "magnitude": 0.30, "business_impact": 0.15, "verification": 0.20, "confidence": 0.25, "novelty": 0.10,
    },
    "time_series_trend": {
        "magnitude": 0.25, "trend_fit": 0.20, "business_impact": 0.15, "verification": 0.15,
        "confidence": 0.20, "novelty": 0.05,
    },
}
NOVELTY = 0.5
# ------------------------------------------------------------------------------


def _weighted(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + parts[name] * weight
    return total


def _rounded(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    return F.create_map(*[
        item for name in weights for item in (F.lit(name), F.bround(parts[name].cast("double"), 4))])


def four_places(value: str) -> Column:
    """Round to 4 places, half to even, in canonical digits so that rounding noise cannot tip a tie."""
    return F.bround(canonical(value), 4)


def _percent_size(field: str, full: float) -> Column:
    """Absolute percentage as a share of ``full``, at most 1; a missing one counts 0."""
    return F.coalesce(clamp(F.abs(F.col(f"evidence.{field}")) / full), F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _confidence_parts() -> dict[str, dict[str, Column]]:
    status = F.col("verification.status")
    verified = _flag(status == "verified")
    p_value = F.coalesce("verification.p_value", "evidence.p_value")
    sample = sample_size_score(F.coalesce("verification.sample_size", "evidence.sample_size"))
    fit = F.coalesce(clamp(F.col("evidence.r_squared")), F.lit(0.0))
    return {
        "correlation": {
            "effect_strength": strength_score(F.col("evidence.correlation")),
            "statistical_significance": p_value_score(p_value),
            "sample_size": sample,
            "verification": verified,
        },
        "group_difference": {
            "effect_strength": _percent_size("percentage_difference", 100),
            "statistical_significance": p_value_score(p_value),
            "minimum_group_sample_size": sample_size_score(
                F.coalesce("verification.minimum_group_size", F.lit(0))),
            "verification": _flag(status.isin("verified", "not_significant")),
        },
        "outlier": {
            "deterministic_detection": _flag(F.col("evidence.outlier_count") > 0),
            "verification": verified,
        },
        "time_series_trend": {
            "trend_fit": F.when(
                F.col("evidence.trend_direction") == "flat", F.greatest(fit, F.lit(0.5))).otherwise(fit),
            "change_magnitude": _percent_size("percentage_change", 25),
            "sample_size": sample,
            "verification": verified,
        },
    }


def with_confidence(insights: DataFrame) -> DataFrame:
    """Add ``confidence``: level, score, factors and reason.

    Failed or insufficient insights have score 0, as have unknown types.
    """
    parts = _confidence_parts()
    kind = F.col("insight_type")
    refused = F.col("verification.status").isin("failed", "insufficient_data")
    score, factors = F.when(refused, F.lit(0.0)), F.when(refused, F.lit(None).cast("map<string,double>"))
    for name, weights in CONFIDENCE_WEIGHTS.items():
        score = score.when(kind == name, clamp(_weighted(weights, parts[name])))
        factors = factors.when(kind == name, _rounded(weights, parts[name]))
    reason = F.when(refused, F.col("verification.status")).when(
        ~kind.isin(*CONFIDENCE_WEIGHTS), F.lit(fixed.REASONS["unsupported_type"]))
    return (
        insights.withColumn("_raw", score.otherwise(F.lit(0.0)))
        .withColumn("_score", four_places("_raw"))
        .withColumn("confidence", F.struct(
            factors.alias("factors"), confidence_level(F.col("_score")).alias("level"),
            reason.alias("reason"), F.col("_score").alias("score")))
        .drop("_raw", "_score")
    )


def with_score(insights: DataFrame) -> DataFrame:
    """Add ``score`` and ``score_components``; an unknown type scores 0."""
    common = {
        "verification": _flag(F.col("verification.status") == "verified"),
        "confidence": F.coalesce("confidence.score", F.lit(0.0)),
        "novelty": F.lit(NOVELTY),
    }

    def sized(size: Column, name: str = "magnitude", **more: Column) -> dict[str, Column]:
        return {**common, name: size, "business_impact": size, **more}

    parts = {
        "group_difference": sized(_percent_size("percentage_difference", 100)),
        "correlation": sized(
            F.coalesce(F.abs("evidence.correlation"), F.lit(0.0)), "statistical_strength"),
        "outlier": sized(outlier_magnitude(F.coalesce("evidence.outlier_count", F.lit(0)))),
        "time_series_trend": sized(
            _percent_size("percentage_change", 100),
            trend_fit=F.coalesce(clamp(F.col("evidence.r_squared")), F.lit(0.0))),
    }
    score, components = F, F
    for name, weights in SCORE_WEIGHTS.items():
        here = F.col("insight_type") == name
        score = score.when(here, _weighted(weights, parts[name]))
        components = components.when(here, _rounded(weights, parts[name]))
    empty = F.create_map().cast("map<string,double>")
    return (
        insights.withColumn("_raw", score.otherwise(F.lit(0.0)))
        .withColumn("score", four_places("_raw"))
        .withColumn("score_components", components.otherwise(empty))
        .drop("_raw")
    )


def deduplicate(insights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the first insight, in plan order, of each type and columns."""
    first = Window.partitionBy(*by, "insight_type", "source_columns").orderBy("ord", "title")
    return insights.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") == 1).drop("_nth")


def rank(insights: DataFrame, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Add ``rank`` to the verified insights: score descending, plan order among equals."""
    order = Window.partitionBy(*[F.col(c) for c in by]).orderBy(F.desc("score"), "ord")
    ranked = verified_only(insights).withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def select_top(insights: DataFrame, by: Sequence[str] = (), limit: int = fixed.TOP_INSIGHTS) -> DataFrame:
    """The ``limit`` best verified insights of each run, one per type and columns."""
    found = verified_only(insights)
    # Dealt by run once, for both windows; a run has no more insights than planned analyses.
    return rank(deduplicate(found.repartition(*by) if by and DEAL not in by else found, by), by, limit)


def priority_list(ranked: DataFrame) -> DataFrame:
    """The findings shown after the top one."""
    return ranked.filter(F.col("rank").between(2, 4))
