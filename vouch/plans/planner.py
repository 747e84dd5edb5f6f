"""The analysis plan as a DataFrame built from the column catalogue.

The catalogue may hold the columns of many tables; ``by`` names the columns
that tell them apart, and every table gets its own plan in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCKS = ["descriptive_statistics", "group_comparison", "time_series", "correlation"]
_FIELDS = ["measure", "dimension", "date", "first", "second"]


def correlation_columns(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows that may enter a correlation."""
    return catalogue.filter(
        F.col("dtype").rlike("^(int|float)") & F.col("role").isin("measure", "numeric")
    )


def column_pairs(catalogue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every unordered pair (first, second) of eligible columns, in column order."""
    eligible = correlation_columns(catalogue)
    left = eligible.select(*by, F.col("ord").alias("a"), F.col("column").alias("first"))
    right = eligible.select(*by, F.col("ord").alias("b"), F.col("column").alias("second"))
    joined = left.join(right, list(by)) if by else left.crossJoin(right)
    return joined.filter(F.col("a") < F.col("b"))


def measure_combinations(catalogue: DataFrame, role: str, by: Sequence[str] = ()) -> DataFrame:
    """Every measure with every column of ``role``, measure-major."""
    left = catalogue.filter(F.col("role") == "measure").select(
        *by, F.col("ord").alias("a"), F.col("column").alias("measure"))
    right = catalogue.filter(F.col("role") == role).select(
        *by, F.col("ord").alias("b"), F.col("column").alias(role))
    return left.join(right, list(by)) if by else left.crossJoin(right)


def _block(df: DataFrame, index: int, by: Sequence[str], description: Column) -> DataFrame:
    def value(name: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(name)

    return df.select(
        *by, F.lit(index).alias("_block"), "a", "b", F.lit(_BLOCKS[index]).alias("type"),
        *[value(name) for name in _FIELDS], description.alias("description"),
    )


def build_plan(catalogue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ord, type, measure, dimension, date, first, second, description)."""
    measures = catalogue.filter(F.col("role") == "measure").select(
        *by, F.col("ord").alias("a"), F.lit(0).alias("b"), F.col("column").alias("measure"))
    blocks = [
        _block(measures, 0, by, F.format_string("Calculate descriptive statistics for %s.", "measure")),
        _block(measure_combinations(catalogue, "dimension", by), 1, by,
               F.format_string("Compare %s across %s.", "measure", "dimension")),
        _block(measure_combinations(catalogue, "date", by), 2, by,
               F.format_string("Analyze %s over time using %s.", "measure", "date")),
        _block(column_pairs(catalogue, by), 3, by,
               F.format_string("Analyze the relationship between %s and %s.", "first", "second")),
    ]
    rows = blocks[0]
    for block in blocks[1:]:
        rows = rows.unionByName(block)
    # One partition holds the plan of one table: at most a few rows per column pair.
    order = Window.partitionBy(*[F.col(c) for c in by]).orderBy("_block", "a", "b")
    return rows.withColumn("ord", F.row_number().over(order)).select(
        *by, "ord", "type", *_FIELDS, "description")


def plan_counts(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of planned analyses per type."""
    return plan.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("analyses"))
