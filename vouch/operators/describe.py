"""Descriptive statistics, IQR fences and outliers for many measures at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.operators.quantiles import DIRECT_CELLS, GROUP_ROWS, long_form, null_safe, order_statistics
from vouch.session import broadcast_if_small
from vouch.sources.tables import column


def basic_statistics(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, count, mean, min, max, std), one aggregate for all measures."""
    totals = df.groupBy(*by).agg(*[
        expression
        for i, name in enumerate(measures)
        for value in [column(name).cast("double")]
        for expression in (
            F.count(value).alias(f"n{i}"), F.avg(value).alias(f"a{i}"), F.min(value).alias(f"l{i}"),
            F.max(value).alias(f"h{i}"), F.stddev_samp(value).alias(f"s{i}"),
        )
    ])
    cells = [
        F.struct(
            F.lit(name).alias("measure"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
            F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"s{i}").alias("std"),
        )
        for i, name in enumerate(measures)
    ]
    return totals.select(*by, F.inline(F.array(*cells)))


def describe(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    *,
    rows: int | None = None,
    direct_cells: int = DIRECT_CELLS,
    group_rows: int = GROUP_ROWS,
    most: int | None = None,
) -> DataFrame:
    """(by..., measure, count, mean, median, min, max, std, q1, q3, iqr, lower_bound, upper_bound, status).

    A measure without values has no quartiles and its status is ``failed``.
    """
    keys = [*by, "measure"]
    quartiles = order_statistics(df, measures, by, rows=rows, direct_cells=direct_cells, group_rows=group_rows, most=most).drop("n")
    joined = null_safe(basic_statistics(df, measures, by), quartiles, keys, "left")
    iqr = F.col("q3") - F.col("q1")
    return joined.withColumn("iqr", iqr).select(
        *keys, "count", "mean", "median", "min", "max", "std", "q1", "q3", "iqr",
        (F.col("q1") - fixed.IQR_FENCE * F.col("iqr")).alias("lower_bound"),
        (F.col("q3") + fixed.IQR_FENCE * F.col("iqr")).alias("upper_bound"),
        F.when(F.col("count") > 0, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
    )


def outlier_values(
    df: DataFrame, statistics: DataFrame, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., measure, value, n): every value outside its fences with its number of rows.

    ``statistics`` should be a written table: it is counted to decide on the broadcast.
    """
    keys = [*by, "measure"]
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    if by:
        # The fences of a run come side by side, so a row is joined once and expanded where it stays.
        fences = statistics.groupBy(*by).agg(*[
            F.max(F.when(F.col("measure") == m, F.col(bound))).alias(f"_{bound}{i}")
            for i, m in enumerate(measures) for bound in ("lower_bound", "upper_bound")])
        rows = df.select(*by, *[column(m).cast("double").alias(f"_v{i}") for i, m in enumerate(measures)])
        rows = null_safe(rows, broadcast_if_small(fences), by)
        cells = [F.struct(
            F.lit(m).alias("measure"), F.col(f"_v{i}").alias("value"), F.col(f"_lower_bound{i}").alias("lower_bound"),
            F.col(f"_upper_bound{i}").alias("upper_bound")) for i, m in enumerate(measures)]
        rows = rows.select(*by, F.inline(F.filter(F.array(*cells), lambda c: (c["value"] < c["lower_bound"]) | (c["value"] > c["upper_bound"]))))
    else:
        rows = null_safe(long_form(df, measures), broadcast_if_small(statistics.select("measure", "lower_bound", "upper_bound")), keys).filter(outside)
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def outlier_recount(
    df: DataFrame, statistics: DataFrame, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``outlier_summary`` from the rows themselves instead of the folded values, for verification."""
    keys = [*by, "measure"]
    fences = statistics.select(*keys, "lower_bound", "upper_bound")
    rows = null_safe(long_form(df, measures, by), broadcast_if_small(fences), keys)
    rows = rows.filter(~F.col("value").between(F.col("lower_bound"), F.col("upper_bound")))
    return outlier_summary(rows.withColumn("n", F.lit(1).cast("long")), by)


def outlier_summary(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, outlier_count, outlier_digest): digest is equal only for equal value lists."""
    # Sum of 64-bit hashes cut to 48 bits: independent of row order and free of overflow.
    weight = F.shiftrightunsigned(F.xxhash64("value"), 16).cast("decimal(20,0)")
    return values.groupBy(*by, "measure").agg(
        F.sum("n").alias("outlier_count"),
        F.sum(weight * F.col("n")).cast("decimal(38,0)").cast("string").alias("outlier_digest"),
    )
