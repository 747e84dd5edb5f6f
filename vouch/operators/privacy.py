"""Finding columns that hold personal data, by name and by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions import fixed
from vouch.functions.text import name_matches, value_matches
from vouch.sources.tables import column


def name_category(name: Column, patterns: dict[str, list[str]] = fixed.PII_NAME_PATTERNS) -> Column:
    """First personal-data category whose patterns occur in a column name, else null."""
    out = F
    for category, members in patterns.items():
        out = out.when(name_matches(name, members), F.lit(category))
    return out.otherwise(F.lit(None).cast("string"))


def by_name(catalogue: DataFrame) -> DataFrame:
    """(column, category) of catalogue columns found by name."""
    return (
        catalogue.withColumn("category", name_category(F.col("column")))
        .filter(F.col("category").isNotNull())
        .select("ord", "column", "category")
    )


def value_shares(
    df: DataFrame, patterns: dict[str, str] = fixed.PII_VALUE_PATTERNS
) -> DataFrame:
    """(ord, column, present, <category> share ...), every column and pattern in one pass.

    Fractional columns print with a decimal point and can match no pattern;
    they are not read.  Non-scalar columns are skipped too.
    """
    readable = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    members = [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, readable)]
    if not members:
        shape = ", ".join(["ord int", "column string", "present bigint"] + [f"{c} double" for c in patterns])
        return df.sparkSession.createDataFrame([], shape)
    totals = df.agg(*[
        expression
        for i, f in members
        for expression in [F.count(column(f.name)).alias(f"n{i}")] + [
            F.count(F.when(value_matches(column(f.name), pattern), 1)).alias(f"{category}{i}")
            for category, pattern in patterns.items()
        ]
    ])
    cells = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(f.name).alias("column"), F.col(f"n{i}").alias("present"),
            *[
                F.when(F.col(f"n{i}") > 0, F.col(f"{category}{i}") / F.col(f"n{i}")).alias(category)
                for category in patterns
            ],
        )
        for i, f in members
    ]
    return totals.select(F.inline(F.array(*cells)))


def by_value(
    df: DataFrame,
    patterns: dict[str, str] = fixed.PII_VALUE_PATTERNS,
    share: float = fixed.PII_MATCH_SHARE,
) -> DataFrame:
    """(ord, column, category) of columns whose values mostly match one pattern; first pattern wins."""
    category = F
    for name in patterns:
        category = category.when(F.col(name) >= share, F.lit(name))
    return (
        value_shares(df, patterns)
        .withColumn("category", category.otherwise(F.lit(None).cast("string")))
        .filter(F.col("category").isNotNull())
        .select("ord", "column", "category")
    )


def detect(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ord, column, category, by_name, by_value); a name finding wins over a value finding."""
    named = by_name(catalogue).withColumnRenamed("category", "by_name")
    valued = by_value(df).withColumnRenamed("category", "by_value")
    return named.join(valued, ["ord", "column"], "full_outer").select(
        "ord", "column", F.coalesce("by_name", "by_value").alias("category"), "by_name", "by_value"
    )
