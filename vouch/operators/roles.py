"""Semantic role of a column, from its name, type and number of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.text import name_matches


def role(name: Column, dtype: Column, unique_count: Column) -> Column:
    """identifier, date, measure, numeric, dimension or unknown; the first rule that fits."""
    numeric = dtype.rlike("^(int|float)") | (dtype == "bool")
    return (
        F.when(name_matches(name, fixed.ID_PATTERNS), F.lit("identifier"))
        .when(name_matches(name, fixed.DATE_PATTERNS), F.lit("date"))
        .when(numeric & name_matches(name, fixed.MEASURE_PATTERNS), F.lit("measure"))
        .when(numeric, F.lit("numeric"))
        .when(name_matches(name, fixed.DIMENSION_PATTERNS), F.lit("dimension"))
        .when((dtype == "str") & (unique_count <= fixed.DIMENSION_MAX_DISTINCT), F.lit("dimension"))
        .otherwise(F.lit("unknown"))
    )


def with_roles(catalogue: DataFrame) -> DataFrame:
    """Add ``role`` to a catalogue holding column, dtype and unique_count."""
    return catalogue.withColumn("role", role(F.col("column"), F.col("dtype"), F.col("unique_count")))
