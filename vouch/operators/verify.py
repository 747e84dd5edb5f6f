"""Checking every claim of an insight against the analysis it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import close_sql
from vouch.operators.insights import EVIDENCE, TREND_FIELDS, record, record_sql
from vouch.operators.quantiles import null_safe

ACTUAL = {
    **EVIDENCE, "groups": "bigint", "outlier_digest": "string", "reason": "string",
    "smallest_count": "bigint", "status": "string",
}
VERIFICATION = {
    "absolute_difference": "double", "alpha": "double", "correlation": "double",
    "highest_group": "string", "highest_value": "double", "lower_bound": "double",
    "lowest_group": "string", "lowest_value": "double", "measure": "string", "method": "string",
    "minimum_group_size": "bigint",
    "mismatches": "array<struct<field:string,claimed:string,actual:string>>",
    "numeric_consistency": "boolean", "outlier_count": "bigint", "p_value": "double",
    "percentage_difference": "double", "r_squared": "double", "reason": "string",
    "required_minimum_group_size": "int", "sample_size": "bigint", "significance": "string",
    "statistic": "double", "status": "string", "test": "string", "trend_direction": "string",
    "upper_bound": "double",
}
_NUMBERS = {"double", "bigint", "int"}


def actuals(
    *,
    groups: DataFrame | None = None,
    correlations: DataFrame | None = None,
    trends: DataFrame | None = None,
    outliers: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Results of all analyses as (by..., insight_type, source_columns, actual)."""
    parts = []

    def add(df: DataFrame | None, kind: str, columns: Sequence[str], fields: Sequence[str], **renamed: str) -> None:
        if df is not None:
            parts.append(df.select(
                *by, F.lit(kind).alias("insight_type"), F.array(*columns).alias("source_columns"),
                record(ACTUAL, {**{f: f for f in fields}, **renamed}).alias("actual"),
            ))

    add(correlations, "correlation", ["first", "second"],
        ["correlation", "p_value", "sample_size", "status", "reason"])
    add(groups, "group_difference", ["measure", "dimension"], [
        "highest_group", "highest_value", "lowest_group", "lowest_value", "absolute_difference",
        "percentage_difference", "statistic", "p_value", "groups", "smallest_count", "sample_size", "status",
    ], statistical_test="test")
    add(trends, "time_series_trend", ["measure", "date"], [*TREND_FIELDS, "status", "reason"])
    add(outliers, "outlier", ["measure"],
        ["outlier_count", "outlier_digest", "lower_bound", "upper_bound", "status"])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _mismatches(fields: Sequence[str]) -> str:
    """SQL array of the fields whose claim differs from the recomputed value."""
    checks = []
    for name in fields:
        claimed, actual = f"evidence.{name}", f"actual.{name}"
        exact = name == "sample_size" or EVIDENCE[name] not in _NUMBERS
        same = f"{claimed} <=> {actual}" if exact else close_sql(claimed, actual)
        checks.append(
            f"case when not ({same}) then named_struct('field', '{name}', "
            f"'claimed', cast({claimed} as string), 'actual', cast({actual} as string)) end")
    return f"array_compact(array({', '.join(checks)}))"


def _verdict(status: str, reason: str | None = None, **fields: str) -> str:
    """SQL struct of a verification; ``status`` is a word or an SQL expression."""
    given = {"status": f"'{status}'" if status.isidentifier() else status, **fields}
    if reason is not None:
        given["reason"] = f"'{fixed.REASONS[reason]}'"
    return record_sql(VERIFICATION, given)


def _copied(*fields: str) -> dict[str, str]:
    return {f: f"actual.{f}" for f in fields}


_SIGNIFICANT = f"actual.p_value < {fixed.ALPHA}D"
_STATUS_BY_P = f"if({_SIGNIFICANT}, 'verified', 'not_significant')"
_TESTED = {
    "significance": f"if({_SIGNIFICANT}, 'statistically_significant', 'not_statistically_significant')",
    "p_value": "actual.p_value", "alpha": f"{fixed.ALPHA}D", "numeric_consistency": "true",
}


def _cases(rules: Sequence[tuple[str, str]], otherwise: str) -> str:
    return f"case {' '.join(f'when {c} then {v}' for c, v in rules)} else {otherwise} end"


def _correlation_verdict() -> str:
    size = {"sample_size": "actual.sample_size"}
    test = {"method": "'pearson_correlation_test'"}
    return _cases([
        ("actual.sample_size is null", _verdict("insufficient_data", "corr_no_size")),
        ("actual.sample_size < 3", _verdict("insufficient_data", "corr_small", **size)),
        ("evidence.correlation is null", _verdict("failed", "corr_no_value", **size)),
        ("evidence.p_value is null",
         _verdict("failed", "corr_no_p", correlation="evidence.correlation", **size)),
        ("evidence.sample_size is null", _verdict("failed", "corr_no_claimed_size", **size)),
        ("size(_wrong) > 0", _verdict("failed", "corr_mismatch", mismatches="_wrong", **test)),
    ], _verdict(_STATUS_BY_P, **size, **test, **_copied("correlation"), **_TESTED))


def _group_verdict() -> str:
    return _cases([
        ("actual.groups < 2", _verdict("insufficient_data", "group_few")),
        (f"actual.smallest_count < {fixed.MIN_GROUP_SIZE}", _verdict(
            "insufficient_data", "group_small", minimum_group_size="actual.smallest_count",
            required_minimum_group_size=str(fixed.MIN_GROUP_SIZE))),
        ("actual.statistical_test is null", _verdict("failed", "group_no_test")),
        ("actual.p_value is null", _verdict("failed", "group_no_p")),
        ("actual.highest_value is null", _verdict("failed", "group_no_means")),
        ("size(_wrong) > 0", _verdict("failed", "group_mismatch", mismatches="_wrong")),
    ], _verdict(
        _STATUS_BY_P, minimum_group_size="actual.smallest_count", test="actual.statistical_test",
        **_copied(
            "statistic", "highest_group", "lowest_group", "highest_value", "lowest_value",
            "absolute_difference", "percentage_difference"),
        **_TESTED))


def _trend_verdict() -> str:
    return _cases([
        ("actual.status != 'completed'", record_sql(VERIFICATION, {
            "status": "'insufficient_data'", **_copied("reason", "sample_size")})),
        ("size(_wrong) > 0", _verdict("failed", "trend_mismatch", mismatches="_wrong")),
    ], _verdict(
        "verified", method="'deterministic_time_series_recalculation'",
        **_copied("sample_size", "trend_direction", "r_squared")))


def _outlier_verdict() -> str:
    same = (
        "evidence.outlier_count <=> actual.outlier_count "
        "and calculation.outlier_digest <=> actual.outlier_digest")
    return _cases([(same, _verdict(
        "verified", method="'iqr_outlier_detection'", measure="source_columns[0]",
        **_copied("outlier_count", "lower_bound", "upper_bound"),
    ))], _verdict("failed", "outlier_mismatch"))


# Fields compared per type.  A group claim without p-value is not compared with one.
_COMPARED = {
    "correlation": _mismatches(["correlation", "p_value", "sample_size"]),
    "group_difference": "filter({}, m -> m.field != 'p_value' or evidence.p_value is not null)".format(
        _mismatches([
            "highest_group", "lowest_group", "highest_value", "lowest_value", "absolute_difference",
            "percentage_difference", "statistical_test", "statistic", "p_value",
        ])),
    "time_series_trend": _mismatches(TREND_FIELDS),
}


def verify(insights: DataFrame, actual: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``verification`` to every insight; none is dropped.

    One equi-join with the recomputed results.  Outliers compare as lists: equal
    counts and an equal order-independent digest.
    """
    matched = null_safe(insights, actual, [*by, "insight_type", "source_columns"], "left")
    compared = [(f"insight_type = '{kind}'", wrong) for kind, wrong in _COMPARED.items()]
    matched = matched.withColumn("_wrong", F.expr(_cases(compared, "null")))
    verdict = _cases([
        ("insight_type = 'outlier' and size(source_columns) = 0", _verdict("failed", "outlier_no_column")),
        ("insight_type = 'outlier' and actual is null", _verdict("failed", "no_describe_result")),
        ("actual is null", _verdict("failed", "no_result")),
        ("insight_type = 'correlation'", _correlation_verdict()),
        ("insight_type = 'group_difference'", _group_verdict()),
        ("insight_type = 'time_series_trend'", _trend_verdict()),
        ("insight_type = 'outlier'", _outlier_verdict()),
    ], _verdict("failed", "unsupported_type"))
    return matched.withColumn("verification", F.expr(verdict)).drop("actual", "_wrong")


def verified_only(insights: DataFrame) -> DataFrame:
    return insights.filter(F.col("verification.status") == "verified")
