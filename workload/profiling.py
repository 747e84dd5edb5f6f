"""Validation, profile, personal data, roles and plans over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.operators import privacy, profile, roles
from vouch.plans import planner
from vouch.session import tasks_for
from vouch.sources.tables import normalise, safe_projection
from workload.registry import query, r, rounded, table, union, union_sql
from workload.tables import (
    CONTACT_COLUMNS,
    CONTACTS_SQL,
    GAPPY_SQL,
    TABLES,
    contacts,
    gappy,
    shared,
)


def lake(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: normalise(table(spark, folder, name)) for name in TABLES}


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), "*")


# --- scans ---------------------------------------------------------------------


@query("scan_profile_counts", union_sql(
    f"SELECT '{name}' AS table_name, count(*) AS row_count, {len(columns)} AS column_count, "
    f"{' + '.join(f'(count(*) - count({c}))' for c in columns)} AS missing_cells FROM {name}"
    for name, columns in TABLES.items()
))
def scan_profile_counts(spark: SparkSession, folder: str) -> DataFrame:
    return union(
        _named(name, profile.column_counts(df)) for name, df in lake(spark, folder).items()
    ).groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
    )


@query("safe_projection", f"WITH {CONTACTS_SQL} SELECT row_no, segment, balance FROM contacts")
def safe_projection_query(spark: SparkSession, folder: str) -> DataFrame:
    df = contacts(spark, folder)
    found = privacy.detect(df, profile.column_counts(df))
    # One row per protected column.
    return safe_projection(df, [row["column"] for row in found.select("column").collect()])


# --- validation ----------------------------------------------------------------


@query("validation_missing", "WITH " + GAPPY_SQL + union_sql(
    f" SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM gappy HAVING count(*) > count({c})"
    for c in TABLES["lineitem"]
))
def validation_missing(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missing_values(gappy(spark, folder))


# Columns of a view, and whole rows of every table.
DUPLICATE_VIEWS = {
    "documents": ["text", "lang"], "events": ["user_id", "event_type"],
    "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["role", "text"],
}


@query("validation_duplicates", union_sql(
    f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) - "
    f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {name})) AS duplicate_rows"
    for name, columns in DUPLICATE_VIEWS.items()
))
def validation_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return union(
        _named(name, profile.duplicate_rows(table(spark, folder, name).select(*columns)))
        for name, columns in DUPLICATE_VIEWS.items()
    )


@query("duplicate_rows_all", union_sql(
    f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows"
    for name in TABLES
))
def duplicate_rows_all(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table that repeat an earlier row in all columns."""
    return union(_named(name, profile.duplicate_rows(table(spark, folder, name))) for name in TABLES)


_SUMMARY_COLUMNS = ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag"]


@query("validation_summary_all", union_sql(
    f"""SELECT '{name}' AS table_name, count(*) > 0 AS valid, count(*) AS row_count, {len(columns)} AS column_count,
  {' + '.join(f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END" for c in columns)} AS columns_with_gaps,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows FROM {name}"""
    for name, columns in TABLES.items()
))
def validation_summary_all(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every table with all its columns."""
    return union(_named(name, profile.validation_summary(df)) for name, df in lake(spark, folder).items()).select(
        "table_name", "valid", "row_count", "column_count", F.size("missing_values").alias("columns_with_gaps"), "duplicate_rows")


@query("validation_summary", f"""
WITH {GAPPY_SQL},
view AS (SELECT {', '.join(_SUMMARY_COLUMNS)} FROM gappy),
facts AS (
  SELECT count(*) AS row_count, count(*) - count(l_discount) AS d, count(*) - count(l_returnflag) AS f,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM view)) AS duplicate_rows
  FROM view)
SELECT row_count > 0 AS valid, CASE WHEN row_count = 0 THEN 1 ELSE 0 END AS error_count,
       concat_ws(' ', CASE WHEN d + f > 0 THEN 'Missing values detected.' END,
                 CASE WHEN duplicate_rows > 0 THEN cast(duplicate_rows AS varchar) || ' duplicate rows detected.' END) AS warnings,
       row_count, 4 AS column_count, d AS missing_discount, f AS missing_flag, duplicate_rows
FROM facts""")
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.validation_summary(gappy(spark, folder).select(*_SUMMARY_COLUMNS)).select(
        "valid", F.size("errors").alias("error_count"), F.concat_ws(" ", "warnings").alias("warnings"),
        "row_count", "column_count", F.col("missing_values")["l_discount"].alias("missing_discount"),
        F.col("missing_values")["l_returnflag"].alias("missing_flag"), "duplicate_rows",
    )


# --- profile -------------------------------------------------------------------

_PROFILE_SQL = union_sql(
    f"SELECT '{name}' AS table_name, {i} AS ord, '{c}' AS \"column\", '{dtype}' AS dtype, "
    f"count(*) AS row_count, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count FROM {name}"
    for name, columns in TABLES.items() for i, (c, dtype) in enumerate(columns.items())
)


def lake_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue of all driver tables with roles."""
    tables = lake(spark, folder)
    # Counts from the footers; a row has several values, most of which are met before.
    largest = union(df.agg(F.count(F.lit(1)).alias("rows")) for df in tables.values()).agg(F.max("rows")).first()[0]
    with tasks_for(spark, largest):
        return shared(spark, folder, "lake-catalogue", lambda: roles.with_roles(union(
            _named(name, profile.profile_columns(df)) for name, df in tables.items())))


@query("profile_columns", f"""
SELECT table_name, "column", dtype, missing_count,
       {r('CASE WHEN row_count > 0 THEN missing_count * 100.0 / row_count END', 2, 'missing_percentage')}, unique_count
FROM (WITH {GAPPY_SQL} {_PROFILE_SQL.replace('FROM lineitem', 'FROM gappy')})""")
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    tables = {**lake(spark, folder), "lineitem": gappy(spark, folder)}
    catalogue = union(_named(name, profile.profile_columns(df)) for name, df in tables.items())
    return rounded(catalogue.select(
        "table_name", "column", "dtype", "missing_count", "missing_percentage", "unique_count",
    ), {"missing_percentage": 2})


_NUMERIC = {
    name: [c for c, dtype in columns.items() if dtype.startswith(("int", "float"))] for name, columns in TABLES.items()
}


@query("profile_numeric", union_sql(
    f"SELECT '{name}' AS table_name, '{c}' AS \"column\", {r(f'min({c})', 4, 'min')}, {r(f'max({c})', 4, 'max')}, "
    f"{r(f'round_even(avg({c}), 4)', 4, 'mean')}, {r(f'median({c})', 4, 'median')}, "
    f"{r(f'round_even(stddev_samp({c}), 4)', 4, 'std')} FROM {name}"
    for name in TABLES for c in _NUMERIC[name]
))
def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(union(
        _named(name, profile.profile_numeric(normalise(table(spark, folder, name)))) for name in TABLES if _NUMERIC[name]
    ), {"min": 4, "max": 4, "mean": 4, "median": 4, "std": 4})


_TEXTS = {
    name: [c for c, dtype in columns.items() if dtype == "str"] for name, columns in TABLES.items()
}


@query("profile_top_values", union_sql(
    f"""SELECT '{name}' AS table_name, '{c}' AS "column", rank, md5(value) AS value_md5, n FROM (
  SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
  FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
    for name in TABLES for c in _TEXTS[name]
))
def profile_top_values(spark: SparkSession, folder: str) -> DataFrame:
    return union(
        _named(name, profile.top_values(table(spark, folder, name))) for name in TABLES if _TEXTS[name]
    ).select("table_name", "column", "rank", F.md5("value").alias("value_md5"), "n")


# --- personal data --------------------------------------------------------------


def _category_sql(name: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower(trim({name})), '{'|'.join(patterns)}') THEN '{category}'"
        for category, patterns in fixed.PII_NAME_PATTERNS.items())
    return f"CASE {cases} END"


_CONTACT_FACTS = union_sql(
    f"SELECT {i} AS ord, '{c}' AS \"column\", count({c}) AS present FROM contacts"
    for i, c in enumerate(CONTACT_COLUMNS))
_VALUE_COLUMNS = [c for c, dtype in CONTACT_COLUMNS.items() if dtype != "float64"]
_SHARES = union_sql(
    f"SELECT '{c}' AS \"column\", count({c}) AS present, " + ", ".join(
        f"avg(CASE WHEN regexp_full_match(trim(cast({c} AS varchar)), '{pattern}') THEN 1.0 ELSE 0.0 END) AS {category}"
        for category, pattern in fixed.PII_VALUE_PATTERNS.items()
    ) + " FROM contacts" for c in _VALUE_COLUMNS)
_VALUE_CATEGORY = "CASE " + " ".join(
    f"WHEN {category} >= {fixed.PII_MATCH_SHARE} THEN '{category}'" for category in fixed.PII_VALUE_PATTERNS) + " END"


@query("pii_by_name", f"""
WITH {CONTACTS_SQL}, facts AS ({_CONTACT_FACTS})
SELECT "column", {_category_sql('"column"')} AS category, present FROM facts
WHERE {_category_sql('"column"')} IS NOT NULL""")
def pii_by_name(spark: SparkSession, folder: str) -> DataFrame:
    counts = profile.column_counts(contacts(spark, folder))
    return privacy.by_name(counts).join(counts, ["ord", "column"]).select(
        "column", "category", (F.col("row_count") - F.col("missing_count")).alias("present"))


@query("pii_by_value", f"""
WITH {CONTACTS_SQL}, shares AS ({_SHARES})
SELECT "column", present, {', '.join(r(c, 6, c) for c in fixed.PII_VALUE_PATTERNS)} FROM shares""")
def pii_by_value(spark: SparkSession, folder: str) -> DataFrame:
    shares = privacy.value_shares(contacts(spark, folder)).drop("ord")
    return rounded(shares, {c: 6 for c in fixed.PII_VALUE_PATTERNS})


@query("pii_columns", f"""
WITH {CONTACTS_SQL}, facts AS ({_CONTACT_FACTS}), shares AS ({_SHARES}),
named AS (SELECT "column", {_category_sql('"column"')} AS by_name FROM facts),
valued AS (SELECT "column", {_VALUE_CATEGORY} AS by_value FROM shares)
SELECT "column", coalesce(by_name, by_value) AS category, by_name, by_value
FROM named LEFT JOIN valued USING ("column") WHERE coalesce(by_name, by_value) IS NOT NULL""")
def pii_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = contacts(spark, folder)
    return privacy.detect(df, profile.column_counts(df)).select("column", "category", "by_name", "by_value")


# --- roles and plans --------------------------------------------------------------


def _matches(patterns: list[str]) -> str:
    return f"regexp_matches(lower(trim(\"column\")), '{'|'.join(patterns)}')"


_NUMBER = "regexp_matches(dtype, '^(int|float)|^bool$')"
CATALOGUE_SQL = f"""
facts AS ({_PROFILE_SQL}),
catalogue AS (
  SELECT *, CASE WHEN {_matches(fixed.ID_PATTERNS)} THEN 'identifier'
    WHEN {_matches(fixed.DATE_PATTERNS)} THEN 'date'
    WHEN {_NUMBER} AND {_matches(fixed.MEASURE_PATTERNS)} THEN 'measure'
    WHEN {_NUMBER} THEN 'numeric'
    WHEN {_matches(fixed.DIMENSION_PATTERNS)} THEN 'dimension'
    WHEN dtype = 'str' AND unique_count <= {fixed.DIMENSION_MAX_DISTINCT} THEN 'dimension'
    ELSE 'unknown' END AS role
  FROM facts)"""
PLAN_SQL = f"""
{CATALOGUE_SQL},
pairs AS (
  SELECT x.table_name, x.ord AS a, y.ord AS b, x."column" AS first, y."column" AS second
  FROM catalogue x JOIN catalogue y ON x.table_name = y.table_name AND x.ord < y.ord
  WHERE regexp_matches(x.dtype, '^(int|float)') AND regexp_matches(y.dtype, '^(int|float)')
    AND x.role IN ('measure', 'numeric') AND y.role IN ('measure', 'numeric')),
combos AS (
  SELECT m.table_name, m.ord AS a, o.ord AS b, m."column" AS measure, o.role, o."column" AS other
  FROM catalogue m JOIN catalogue o USING (table_name) WHERE m.role = 'measure' AND o.role IN ('dimension', 'date')),
blocks AS (
  SELECT table_name, 0 AS block, ord AS a, 0 AS b, 'descriptive_statistics' AS type, "column" AS measure,
         NULL AS dimension, NULL AS date, NULL AS first, NULL AS second,
         'Calculate descriptive statistics for ' || "column" || '.' AS description
  FROM catalogue WHERE role = 'measure'
  UNION ALL SELECT table_name, 1, a, b, 'group_comparison', measure, other, NULL, NULL, NULL,
         'Compare ' || measure || ' across ' || other || '.' FROM combos WHERE role = 'dimension'
  UNION ALL SELECT table_name, 2, a, b, 'time_series', measure, NULL, other, NULL, NULL,
         'Analyze ' || measure || ' over time using ' || other || '.' FROM combos WHERE role = 'date'
  UNION ALL SELECT table_name, 3, a, b, 'correlation', NULL, NULL, NULL, first, second,
         'Analyze the relationship between ' || first || ' and ' || second || '.' FROM pairs),
plan AS (
  SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY block, a, b) AS ord FROM blocks)"""


@query("column_roles", f"""WITH {CATALOGUE_SQL} SELECT table_name, "column", dtype, unique_count, role FROM catalogue""")
def column_roles(spark: SparkSession, folder: str) -> DataFrame:
    return lake_catalogue(spark, folder).select("table_name", "column", "dtype", "unique_count", "role")


@query("plan_pairs", f"WITH {PLAN_SQL} SELECT table_name, first, second FROM pairs")
def plan_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return planner.column_pairs(lake_catalogue(spark, folder), ["table_name"]).select("table_name", "first", "second")


@query("plan_cross", f"WITH {PLAN_SQL} SELECT table_name, measure, role, other FROM combos")
def plan_cross(spark: SparkSession, folder: str) -> DataFrame:
    catalogue = lake_catalogue(spark, folder)
    return union(
        planner.measure_combinations(catalogue, role, ["table_name"]).select(
            "table_name", "measure", F.lit(role).alias("role"), F.col(role).alias("other"))
        for role in ("dimension", "date")
    )


@query("analytics_plan", f"""WITH {PLAN_SQL}
SELECT table_name, ord, type, measure, dimension, date, first, second, description FROM plan""")
def analytics_plan(spark: SparkSession, folder: str) -> DataFrame:
    return planner.build_plan(lake_catalogue(spark, folder), ["table_name"])


@query("plan_counts", f"WITH {PLAN_SQL} SELECT table_name, type, count(*) AS analyses FROM plan GROUP BY ALL")
def plan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return planner.plan_counts(planner.build_plan(lake_catalogue(spark, folder), ["table_name"]), ["table_name"])
