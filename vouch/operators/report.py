"""Report rows, summaries and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.functions.numbers import number_text_sql
from vouch.functions.text import json_sql, spreadsheet_safe
from vouch.operators.insights import EVIDENCE
from vouch.operators.quantiles import null_safe, same_key

MERGE_KEY = ["insight_type", "method", "source_columns", "title"]
LEVELS = ["high", "medium", "low"]


def run_key() -> Column:
    """type::method::columns..., the identity of an insight across runs."""
    return F.concat_ws("::", "insight_type", "method", F.array_join("source_columns", "::"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") == 1).drop("_nth")


def report_rows(
    ranked: DataFrame, explained: DataFrame, recommended: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """One row per ranked insight with its explanation and recommendation, 16 report columns.

    Where several rows share the merge key the last ranked one counts.
    """
    keys = [*by, *MERGE_KEY]
    texts = keep_last(explained.select(*keys, "rank", "explanation"), keys, F.col("rank")).drop("rank")
    advice = keep_last(recommended.select(*keys, "rank", "recommendation"), keys, F.col("rank")).drop("rank")
    base = ranked.drop("explanation", "recommendation")
    merged = null_safe(null_safe(base, texts, keys, "left"), advice, keys, "left")
    return ranked_rows(merged, by)


def ranked_rows(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report columns of insights that carry their explanation and recommendation."""
    return ranked.select(
        *by, "rank", "insight_type", "title",
        F.array_join("source_columns", ", ").alias("source_columns"), "method",
        F.col("verification.status").alias("verification_status"),
        F.col("confidence.level").alias("confidence_level"),
        F.col("confidence.score").alias("confidence_score"),
        F.col("score").alias("priority_score"),
        "evidence", "limitations",
        F.col("explanation.status").alias("explanation_status"),
        F.coalesce("explanation.text", F.lit("")).alias("explanation"),
        F.col("recommendation.action").alias("recommendation_action"),
        F.col("recommendation.reason").alias("recommendation_reason"),
        F.col("recommendation.priority").alias("recommendation_priority"),
    )


def empty_ranked(spark: SparkSession) -> DataFrame:
    """A ranked table without rows, for runs that found nothing."""
    evidence = ", ".join(f"{name}: {kind}" for name, kind in EVIDENCE.items())
    return spark.createDataFrame([], f"""run_id string, rank int, insight_type string, title string,
        source_columns array<string>, method string, verification struct<status: string>,
        confidence struct<level: string, score: double>, score double, evidence struct<{evidence}>,
        limitations array<string>, explanation struct<status: string, text: string>,
        recommendation struct<action: string, reason: string, priority: string>""")


def report_cells(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Report rows as spreadsheet-safe text; numbers stay numbers, records and lists become JSON."""
    out = []
    for name in fixed.REPORT_COLUMNS:
        kind = rows.schema[name].dataType
        if isinstance(kind, (T.StructType, T.ArrayType)):
            out.append(spreadsheet_safe(F.expr(json_sql(name, kind))).alias(name))
        elif isinstance(kind, T.StringType):
            out.append(spreadsheet_safe(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return rows.select(*by, *out)


def level_counts(level: Column) -> list[Column]:
    return [F.count(F.when(F.lower(level) == name, 1)).alias(name) for name in LEVELS]


def run_summary(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., verified_signals, high, medium, low, top_title, top_score)."""
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("verified_signals"),
        *level_counts(F.col("confidence.level")),
        F.min_by("title", "rank").alias("top_title"),
        F.min_by("score", "rank").alias("top_score"),
    )


def evidence_rows(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rank, title, field, value): one row per evidence field that has a value."""
    cells = []
    for field in ranked.schema["evidence"].dataType.fields:
        value = f"evidence.{field.name}"
        text = number_text_sql(value) if isinstance(field.dataType, T.DoubleType) else f"cast({value} as string)"
        cells.append(f"named_struct('field', '{field.name}', 'value', {text})")
    return ranked.select(*by, "rank", "title", F.expr(f"inline(array({', '.join(cells)}))")).filter(
        F.col("value").isNotNull())


def headline_metric(df: DataFrame) -> DataFrame:
    """Add ``metric_label`` and ``metric_value``, the number that sums up an insight.

    ``metric_value`` is null when there is none; a change keeps its sign and a
    difference is absolute (both in percent).
    """
    kind = F.col("insight_type")
    rules = [
        ("time_series_trend", "percentage_change", "Overall change", lambda v: v),
        ("correlation", "correlation", "Correlation", lambda v: v),
        ("group_difference", "percentage_difference", "Difference", F.abs),
        ("outlier", "outlier_count", "Outliers", lambda v: v.cast("double")),
    ]
    label, value = F, F
    for name, field, text, shape in rules:
        field_value = F.col(f"evidence.{field}")
        here = (kind == name) & field_value.isNotNull()
        label, value = label.when(here, F.lit(text)), value.when(here, shape(field_value))
    label = label.when(F.col("score").isNotNull(), F.lit("Priority score"))
    return df.withColumn("metric_label", label).withColumn("metric_value", value.otherwise(F.col("score")))


def compare_runs(baseline: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, change, before/after title, level and score, score_delta, confidence_delta).

    ``change`` is added, removed or changed; unchanged insights are left out.
    Where a run repeats a key its last ranked insight counts.
    """
    keys = [*by, "key"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        keyed = df.withColumn("key", run_key())
        return keep_last(keyed, keys, F.col("rank")).select(
            *[F.col(k).alias(f"_{prefix}_{k}") for k in keys],
            F.col("title").alias(f"{prefix}_title"), F.col("confidence.level").alias(f"{prefix}_level"),
            F.col("score").alias(f"{prefix}_score"), F.col("confidence.score").alias(f"{prefix}_confidence"),
        )

    condition = F.lit(True)
    for k in keys:
        condition = condition & same_key(F.col(f"_before_{k}"), F.col(f"_after_{k}"), k)
    joined = side(baseline, "before").join(side(current, "after"), condition, "full_outer")
    score_delta = F.col("after_score") - F.col("before_score")
    confidence_delta = F.col("after_confidence") - F.col("before_confidence")
    differs = (
        (F.coalesce(F.abs(score_delta), F.lit(0.0)) > 1e-9)
        | (F.coalesce(F.abs(confidence_delta), F.lit(0.0)) > 1e-9)
        | ~F.col("before_level").eqNullSafe(F.col("after_level"))
        | ~F.col("before_title").eqNullSafe(F.col("after_title"))
    )
    change = (
        F.when(F.col("_before_key").isNull(), F.lit("added"))
        .when(F.col("_after_key").isNull(), F.lit("removed"))
        .when(differs, F.lit("changed"))
    )
    return joined.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        *[F.coalesce(f"_before_{k}", f"_after_{k}").alias(k) for k in keys], "change",
        "before_title", "after_title", "before_level", "after_level", "before_score", "after_score",
        score_delta.alias("score_delta"), confidence_delta.alias("confidence_delta"),
    )
