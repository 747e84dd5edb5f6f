"""Insights from analysis results: one row per finding, one shape for all types.

Evidence, calculation and verification are structs with every field any type
uses; fields that do not apply are null.  Field order is alphabetical so that
their JSON form has sorted keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import percent_change
from vouch.functions.scores import correlation_label
from vouch.operators.quantiles import null_safe
from vouch.session import broadcast_if_small, materialise

EVIDENCE = {
    "absolute_change": "double", "absolute_difference": "double", "correlation": "double",
    "direction": "string", "first_date": "string", "first_value": "double",
    "highest_group": "string", "highest_value": "double", "last_date": "string",
    "last_value": "double", "latest_moving_average": "double", "latest_period_change": "double",
    "latest_period_percentage_change": "double", "lower_bound": "double", "lowest_group": "string",
    "lowest_value": "double", "moving_average_window": "int", "outlier_count": "bigint",
    "p_value": "double", "peak_date": "string", "peak_value": "double",
    "percentage_change": "double", "percentage_difference": "double", "r_squared": "double",
    "sample_size": "bigint", "statistic": "double", "statistical_test": "string",
    "strength": "string", "trend_direction": "string", "trend_strength": "string",
    "trough_date": "string", "trough_value": "double", "upper_bound": "double",
}
CALCULATION = {
    "absolute_difference": "double", "comparison": "string", "formula": "string", "iqr": "double",
    "lower_bound": "double", "method": "string", "outlier_digest": "string",
    "percentage_difference": "double", "q1": "double", "q3": "double", "r_squared": "double",
    "slope_per_observation": "double", "upper_bound": "double", "value": "double",
}
TREND_FIELDS = [f for f in fixed.TREND_NUMBER_FIELDS + fixed.TREND_TEXT_FIELDS]


def record_sql(shape: Mapping[str, str], given: Mapping[str, str]) -> str:
    """SQL text of a struct of ``shape`` with the given fields set and the others null."""
    cells = [f"'{name}', cast({given.get(name, 'null')} as {kind})" for name, kind in shape.items()]
    return f"named_struct({', '.join(cells)})"


def record(shape: Mapping[str, str], given: Mapping[str, str]) -> Column:
    return F.expr(record_sql(shape, given))


def _insight(
    df: DataFrame,
    by: Sequence[str],
    kind: str,
    title: Column,
    columns: Sequence[str],
    evidence: Mapping[str, str],
    calculation: Mapping[str, str],
) -> DataFrame:
    return df.select(
        *by,
        F.lit(kind).alias("insight_type"),
        title.alias("title"),
        F.array(*columns).alias("source_columns"),
        F.lit(fixed.METHODS[kind]).alias("method"),
        record(EVIDENCE, evidence).alias("evidence"),
        record(CALCULATION, calculation).alias("calculation"),
        F.array(*[F.lit(t) for t in fixed.LIMITATIONS[kind]]).alias("limitations"),
    )


def group_result(extremes: DataFrame, tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Extremes and test of each group comparison in one row."""
    difference = F.col("highest_value") - F.col("lowest_value")
    return null_safe(tests, extremes, [*by, "measure", "dimension"], "left").select(
        "*",
        difference.alias("absolute_difference"),
        percent_change(difference, F.col("lowest_value")).alias("percentage_difference"),
    )


def group_insights(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A finding per comparison of at least two groups that have values."""
    fields = [
        "highest_group", "highest_value", "lowest_group", "lowest_value", "absolute_difference",
        "percentage_difference", "statistic", "p_value",
    ]
    title = F.concat(
        F.coalesce("highest_group", F.lit("None")), F.lit(" has the highest average "), F.col("measure"))
    return _insight(
        result.filter((F.col("groups") >= 2) & F.col("highest_value").isNotNull()),
        by, "group_difference", title, ["measure", "dimension"],
        {**{f: f for f in fields}, "statistical_test": "test"},
        {
            "comparison": "'highest_group_mean - lowest_group_mean'",
            "absolute_difference": "absolute_difference",
            "percentage_difference": "percentage_difference",
        },
    )


def trend_insights(trends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    shown = F.when(F.col("trend_direction") == "flat", F.lit("stable")).otherwise(F.col("trend_direction"))
    return _insight(
        trends.filter(F.col("status") == "completed"),
        by, "time_series_trend",
        F.format_string("%s shows a %s trend over %s", F.col("measure"), shown, F.col("date")),
        ["measure", "date"],
        {f: f for f in TREND_FIELDS},
        {
            "method": "'linear trend over chronologically sorted observations'",
            "slope_per_observation": "slope_per_observation", "r_squared": "r_squared",
        },
    )


def correlation_insights(correlations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A finding per pair whose correlation reaches the weakest label."""
    label = correlation_label(F.col("correlation"))
    direction = F.when(F.col("correlation") > 0, F.lit("positive")).otherwise(F.lit("negative"))
    return _insight(
        correlations.select("*", label.alias("_label"), direction.alias("_direction"))
        .filter(F.col("_label").isNotNull()),
        by, "correlation",
        F.format_string("%s and %s have a %s %s relationship", "first", "second", "_label", "_direction"),
        ["first", "second"],
        {
            "correlation": "correlation", "strength": "_label", "direction": "_direction",
            "p_value": "p_value", "sample_size": "sample_size",
        },
        {"formula": "'Pearson correlation coefficient'", "value": "correlation"},
    )


def outlier_result(statistics: DataFrame, summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of each measure with the count and digest of its outliers (0 and null without any)."""
    return null_safe(statistics, summary, [*by, "measure"], "left").withColumn(
        "outlier_count", F.coalesce("outlier_count", F.lit(0)))


def outlier_insights(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _insight(
        result.filter(F.col("outlier_count") > 0),
        by, "outlier",
        F.concat(F.lit("Potential outliers detected in "), F.col("measure")), ["measure"],
        {"outlier_count": "outlier_count", "lower_bound": "lower_bound", "upper_bound": "upper_bound"},
        {
            "method": "'IQR'", "q1": "q1", "q3": "q3", "iqr": "iqr", "lower_bound": "lower_bound",
            "upper_bound": "upper_bound", "outlier_digest": "outlier_digest",
        },
    )


def plan_keys(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ord, insight_type, source_columns) of each planned analysis."""
    kind = F
    for insight_type, analysis in fixed.ANALYSIS_OF.items():
        kind = kind.when(F.col("type") == analysis, F.lit(insight_type))
    columns = F.array_compact(F.array("first", "second", "measure", "dimension", "date"))
    return plan.select(*by, "ord", kind.alias("insight_type"), columns.alias("source_columns"))


def discover(
    *,
    groups: DataFrame | None = None,
    correlations: DataFrame | None = None,
    trends: DataFrame | None = None,
    outliers: DataFrame | None = None,
    plan: DataFrame | None = None,
    by: Sequence[str] = (),
    plan_by: Sequence[str] = (),
) -> DataFrame:
    """All findings of the given results, with ``ord`` from the plan.

    ``plan_by`` are the columns of ``by`` the plan is specific to; by default one
    plan covers all runs.  Without a plan ``ord`` follows type and columns.
    """
    parts = []
    if groups is not None:
        parts.append(group_insights(groups, by))
    if correlations is not None:
        parts.append(correlation_insights(correlations, by))
    if trends is not None:
        parts.append(trend_insights(trends, by))
    if outliers is not None:
        parts.append(outlier_insights(outliers, by))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if plan is not None:
        keys = [*plan_by, "insight_type", "source_columns"]
        # Its rows are bounded by the columns, unless every run has a plan of its own.
        planned = broadcast_if_small(materialise(plan_keys(plan, plan_by), "plan-keys"))
        found = found.join(planned, keys, "left")
    else:
        kinds = F.array(*[F.lit(k) for k in ("outlier", "group_difference", "time_series_trend", "correlation")])
        found = found.withColumn("ord", F.concat_ws(
            "|", F.array_position(kinds, F.col("insight_type")).cast("string"), F.array_join("source_columns", "|")))
    # An insight that breaks the contract is an error, not a row less.
    return found.filter(F.assert_true(contract_holds(), F.lit("an insight must name its type, title and method")).isNull()).select(
        *by, "ord", "insight_type", "title", "source_columns", "method", "evidence", "calculation", "limitations")


def contract_holds() -> Column:
    """An insight must name its type, title and method."""
    return F.col("insight_type").isNotNull() & F.col("title").isNotNull() & F.col("method").isNotNull()
