"""Explanations in words, and the guardrail that every number in them must pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.functions.numbers import canonical, canonical_sql, number_text_sql, numbers_in_sql
from vouch.functions.text import template_sql
from vouch.operators.quantiles import null_safe
from vouch.operators.verify import verified_only

BOUNDARY_FIELDS = [
    "insight_type", "title", "source_columns", "method", "evidence", "verification", "limitations",
]
KEY = ["insight_type", "source_columns"]


def _canonical_struct(df: DataFrame, name: str) -> Column:
    """The struct with its doubles cut to canonical digits."""
    cells = []
    for field in df.schema[name].dataType.fields:
        value = f"{name}.{field.name}"
        cells.append(f"'{field.name}', {canonical_sql(value) if isinstance(field.dataType, T.DoubleType) else value}")
    return F.expr(f"named_struct({', '.join(cells)})")


def evidence_boundary(insights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The only fields an explanation may see, of verified insights only, numbers canonical."""
    safe = verified_only(insights)
    return safe.select(*by, *[
        _canonical_struct(safe, f).alias(f) if f in ("evidence", "verification") else F.col(f)
        for f in BOUNDARY_FIELDS
    ])


def _fields(boundary: DataFrame) -> dict[str, str]:
    """SQL texts the sentence templates can name."""
    out = {
        "first": "get(source_columns, 0)", "second": "get(source_columns, 1)",
        "title": "title", "limitation": "get(limitations, 0)",
    }
    for field in boundary.schema["evidence"].dataType.fields:
        value = f"evidence.{field.name}"
        out[field.name] = (
            number_text_sql(value) if isinstance(field.dataType, T.DoubleType) else f"cast({value} as string)")
    return out


def local_text(boundary: DataFrame) -> Column:
    """Sentences built from canonical evidence; a sentence with a missing value is left out."""
    fields = _fields(boundary)
    closing = template_sql(fixed.EXPLANATION_LIMITATION, fields)
    cases, otherwise = [], ""
    for kind, sentences in fixed.EXPLANATIONS.items():
        text = f"concat_ws(' ', {', '.join(template_sql(s, fields) for s in sentences)}, {closing})"
        if kind is None:
            otherwise = text
        else:
            cases.append(f"when insight_type = '{kind}' then {text}")
    return F.expr(f"case {' '.join(cases)} else {otherwise} end")


def record_numbers(df: DataFrame, name: str) -> str:
    """SQL array of every number in a struct column: numeric fields and digits inside its texts."""
    found = []
    for field in df.schema[name].dataType.fields:
        value = f"{name}.{field.name}"
        if isinstance(field.dataType, T.StringType):
            found.append(f"coalesce({numbers_in_sql(value)}, cast(array() as array<double>))")
        elif isinstance(field.dataType, T.NumericType):
            found.append(f"array(cast({value} as double))")
    return f"array_compact(concat({', '.join(found)}))"


def allowed_numbers(boundary: DataFrame) -> Column:
    return F.expr(f"concat({record_numbers(boundary, 'evidence')}, {record_numbers(boundary, 'verification')})")


def unsupported(text: str, allowed: str) -> Column:
    """Numbers of a text that equal none of the allowed ones, in text order."""
    return F.expr(f"filter({numbers_in_sql(text)}, x -> not array_contains({allowed}, x))")


def unsupported_in(texts: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., value) of numbers in ``texts.text`` absent from the ``allowed`` table (keys..., value).

    The table form, for allowed numbers too many to sit in a row.
    """
    said = texts.select(*keys, F.explode(F.expr(numbers_in_sql("text"))).alias("value"))
    return said.join(allowed.select(*keys, "value").distinct(), [*keys, "value"], "left_anti")


def guard(
    boundary: DataFrame,
    text: Column,
    by: Sequence[str] = (),
    outlier_values: DataFrame | None = None,
    group_sizes: DataFrame | None = None,
) -> DataFrame:
    """Add explanation, status, valid, reason and unsupported_numbers for a proposed ``text``.

    ``outlier_values`` (by..., measure, value) and ``group_sizes`` (by..., measure,
    dimension, count) add the listed outliers and the sizes of all groups to the
    numbers that an explanation of such an insight may state.
    """
    checked = boundary.withColumn("_text", text).withColumn("_allowed", allowed_numbers(boundary))
    checked = checked.withColumn("unsupported_numbers", F.coalesce(
        unsupported("_text", "_allowed"), F.array().cast("array<double>")))
    details = []
    if outlier_values is not None:
        details.append(outlier_values.select(
            *by, F.lit("outlier").alias("insight_type"), F.array("measure").alias("source_columns"),
            canonical("value").alias("value")))
    if group_sizes is not None:
        details.append(group_sizes.select(
            *by, F.lit("group_difference").alias("insight_type"), F.array("measure", "dimension").alias("source_columns"),
            F.col("count").cast("double").alias("value")))
    for detail in details:
        keys = [*by, *KEY]
        open_numbers = checked.filter(F.size("unsupported_numbers") > 0).select(
            *keys, F.explode("unsupported_numbers").alias("value")).distinct()
        known = null_safe(open_numbers, detail.distinct(), [*keys, "value"])
        known = known.groupBy(*keys).agg(F.collect_set("value").alias("_known"))  # numbers of one text
        checked = null_safe(checked, known, keys, "left").withColumn("unsupported_numbers", F.filter(
            "unsupported_numbers",
            lambda x: ~F.array_contains(F.coalesce("_known", F.array().cast("array<double>")), x),
        )).drop("_known")
    blank = F.coalesce(F.trim("_text"), F.lit("")) == ""
    approved = ~blank & (F.size("unsupported_numbers") == 0)
    return checked.select(
        *boundary.columns,
        F.when(approved, F.col("_text")).alias("explanation"),
        F.when(approved, F.lit("approved")).otherwise(F.lit("rejected")).alias("status"),
        approved.alias("valid"),
        F.when(blank, F.lit("invalid_response")).alias("reason"),
        "unsupported_numbers",
    )


def explain_local(insights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Guarded deterministic explanation of every verified insight."""
    boundary = evidence_boundary(insights, by)
    return guard(boundary, local_text(boundary), by).withColumn("source", F.lit("deterministic"))


def check_candidates(
    insights: DataFrame, candidates: DataFrame, by: Sequence[str] = (), outlier_values: DataFrame | None = None,
    group_sizes: DataFrame | None = None,
) -> DataFrame:
    """Verdict on a supplied text for each insight: (by..., key, status, reason, explanation, unsupported_numbers).

    ``candidates`` holds by..., insight_type, source_columns and text.  An insight
    that is not verified is rejected, one without a candidate is unavailable.  Of
    several candidates for one insight the first in text order counts.
    """
    boundary = evidence_boundary(insights, by)
    keys = [*by, *KEY]
    offered = candidates.groupBy(*keys).agg(F.min("text").alias("text"), F.lit(True).alias("_offered"))
    joined = null_safe(boundary, offered, keys, "left")
    judged = guard(joined, F.col("text"), by, outlier_values, group_sizes).select(
        *keys,
        F.when(F.col("_offered").isNull(), F.lit("unavailable")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_offered").isNull(), F.lit("llm_unavailable")).otherwise(F.col("reason")).alias("reason"),
        "explanation", "unsupported_numbers",
    )
    refused = insights.filter(~F.col("verification.status").eqNullSafe("verified")).select(
        *keys, F.lit("rejected").alias("status"), F.lit("insight_not_verified").alias("reason"),
        F.lit(None).cast("string").alias("explanation"),
        F.array().cast("array<double>").alias("unsupported_numbers"),
    )
    return judged.unionByName(refused)


def explain_ranked(
    ranked: DataFrame,
    candidates: DataFrame | None = None,
    limit: int = fixed.EXPLAIN_LIMIT,
    by: Sequence[str] = (),
    outlier_values: DataFrame | None = None,
    group_sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``explanation`` to ranked insights: text, status, source and unsupported numbers.

    Ranks up to ``limit`` use an approved candidate text; all others, and rejected
    candidates, use the deterministic text.
    """
    limit = max(0, min(int(limit), fixed.EXPLAIN_LIMIT_MAX))
    keys = [*by, *KEY]
    local = explain_local(ranked, by).select(
        *keys, F.col("explanation").alias("_local"), F.col("status").alias("_local_status"),
        F.col("unsupported_numbers").alias("_local_numbers"))
    # Texts are wider than Spark guesses from the size of their files, so they are not for broadcast.
    joined = null_safe(ranked, local.hint("merge"), keys, "left")
    if candidates is None or limit == 0:
        use = F.lit(False)
        joined = joined.withColumn("_offered_text", F.lit(None).cast("string"))
    else:
        judged = check_candidates(ranked.filter(F.col("rank") <= limit), candidates, by, outlier_values, group_sizes)
        judged = judged.filter(F.col("status") == "approved").select(
            *keys, F.col("explanation").alias("_offered_text"))
        joined = null_safe(joined, judged, keys, "left")
        use = F.col("_offered_text").isNotNull() & (F.col("rank") <= limit)
    empty = F.array().cast("array<double>")
    approved = use | (F.col("_local_status") == "approved")
    return joined.withColumn("explanation", F.struct(
        F.when(approved, F.lit("approved")).otherwise(F.lit("rejected")).alias("status"),
        F.when(use, F.col("_offered_text")).otherwise(F.col("_local")).alias("text"),
        # A rejected text names no source.
        F.when(use, F.lit("llm")).when(approved, F.lit("deterministic")).alias("source"),
        F.when(use, empty).otherwise(F.coalesce("_local_numbers", empty)).alias("unsupported_numbers"),
    )).drop("_local", "_local_status", "_local_numbers", "_offered_text")


def recommend(insights: DataFrame) -> DataFrame:
    """Add ``recommendation``: action, reason and priority by insight type."""
    fields = {
        "first": "coalesce(get(source_columns, 0), 'the measure')",
        "second": "coalesce(get(source_columns, 1), 'second variable')",
        "highest_group": "coalesce(evidence.highest_group, 'None')",
        "lowest_group": "coalesce(evidence.lowest_group, 'None')",
        "direction": "coalesce(evidence.trend_direction, 'observed')",
    }
    cases, otherwise = [], ""
    for kind, (action, reason, priority) in fixed.RECOMMENDATIONS.items():
        advice = (
            f"named_struct('action', {template_sql(action, fields)}, 'reason', '{reason}', 'priority', '{priority}')")
        if kind is None:
            otherwise = advice
        else:
            cases.append(f"when insight_type = '{kind}' then {advice}")
    return insights.withColumn("recommendation", F.expr(f"case {' '.join(cases)} else {otherwise} end"))
