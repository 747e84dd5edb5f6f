"""Insights of many runs at once: every part of ``lineitem`` is one run.

The lines of one part are analysed as a table of their own: descriptive
statistics and trend of three measures, group comparison by return flag, and
correlation of the three pairs.  The SQL side computes the same tables as CTEs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vouch.operators import correlation, describe, groups, insights, ranking, series, verify
from vouch.session import DEAL, GROUP_ROWS, materialise, tasks, tasks_for, together, with_deal
from workload.registry import query, r, rounded, table, union
from workload.statistics import MEASURES, beta_sql, quartile_sql
from workload.tables import LINE_ORDER, shared
from workload.timelines import label_sql, trend_sql

BY = [DEAL, "run_id"]
PAIRS = list(combinations(MEASURES, 2))
# Two periods make two runs of each part to compare.
PERIODS = {"all": "true", "early": "l_shipdate < timestamp '1998-07-01'", "late": "l_shipdate >= timestamp '1998-07-01'"}

# --- Spark side --------------------------------------------------------------------


def runs(spark: SparkSession, folder: str, period: str = "all") -> DataFrame:
    return with_deal(table(spark, folder, "lineitem").filter(PERIODS[period]).withColumn("run_id", F.col("l_partkey")), ["run_id"])


def sizes(spark: SparkSession, folder: str, period: str = "all") -> Row:
    """``most``, the rows of the largest run, and ``rows``, those of all."""
    counted = shared(spark, folder, f"sizes-{period}", lambda: runs(spark, folder, period).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))
    return counted.first()


def buckets(spark: SparkSession, folder: str) -> int:
    """In how many buckets tables of runs are written; 0 if a run is too large to lie in one."""
    size = sizes(spark, folder)
    return tasks(spark, size["rows"]) if size["most"] <= GROUP_ROWS else 0


def dealt_runs(spark: SparkSession, folder: str, period: str = "all") -> DataFrame:
    """``runs`` dealt by run once for all analyses and periods, unless a run is too large for that."""
    number = buckets(spark, folder)
    if not number:
        return runs(spark, folder, period)
    used = list(dict.fromkeys([*BY, *MEASURES, "l_returnflag", "l_shipdate", *LINE_ORDER]))
    return shared(spark, folder, f"dealt-{number}", lambda: runs(spark, folder).select(*used).repartition(number, DEAL), number).filter(PERIODS[period])


def results(spark: SparkSession, folder: str, period: str = "all") -> dict[str, DataFrame]:
    """Analysis results of every run, one table per type."""
    def build(name: str) -> DataFrame:
        df = dealt_runs(spark, folder, period)
        if name == "outliers":
            # Few rows are left once they are compared with the fences: nothing to deal before.
            statistics = written("statistics")
            values = describe.outlier_values(df, statistics, MEASURES, BY)
            return insights.outlier_result(statistics, describe.outlier_summary(values, BY), BY)
        if name == "trends":
            moments = series.series_moments(df, MEASURES, "l_shipdate", LINE_ORDER, BY, most=size["most"], dealt=bool(number))
            return series.trends(moments, "l_shipdate", BY)
        df = df if number else together(df, BY, size["most"])
        if name == "correlations":
            return correlation.correlations(df, PAIRS, BY)
        if name == "statistics":
            return describe.describe(df, MEASURES, BY, most=size["most"])
        table_ = materialise(groups.group_statistics(
            df, MEASURES, ["l_returnflag"], BY, medians=False), "run-groups", buckets=number)
        return insights.group_result(groups.extremes(table_, BY), groups.anova(table_, BY), BY)

    def written(name: str) -> DataFrame:
        return shared(spark, folder, f"{name}-{period}", lambda: build(name), number)

    size, number = sizes(spark, folder, period), buckets(spark, folder)
    with tasks_for(spark, size["rows"]):
        return {name: written(name) for name in ("correlations", "trends", "outliers", "groups")}


def plan(spark: SparkSession) -> DataFrame:
    """The plan all runs share; it has one row per analysis of the five columns."""
    from vouch.plans.planner import build_plan

    roles = [(c, "float64", "measure") for c in MEASURES] + [
        ("l_returnflag", "str", "dimension"), ("l_shipdate", "timestamp", "date")]
    catalogue = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(roles)], "ord int, column string, dtype string, role string")
    # A few rows: one task, not one for every two of a cross join's parts.
    return build_plan(catalogue.coalesce(1))


def discovered(spark: SparkSession, folder: str, period: str = "all") -> DataFrame:
    return insights.discover(**results(spark, folder, period), plan=plan(spark), by=BY)


def tampered(df: DataFrame) -> DataFrame:
    """Insights with some claims changed: every claim about these columns becomes wrong."""
    first, second, kind = F.col("source_columns")[0], F.get("source_columns", F.lit(1)), F.col("insight_type")

    def changed(field: str, condition, value):
        return F.when(condition, value).otherwise(F.col(f"evidence.{field}"))

    return df.withColumn("evidence", F.col("evidence").withField(
        "correlation", changed("correlation", (kind == "correlation") & (second == "l_discount"),
                               F.col("evidence.correlation") * 0.9),
    ).withField(
        "highest_value", changed("highest_value", (kind == "group_difference") & (first == "l_discount"),
                                 F.col("evidence.highest_value") + 1),
    ).withField(
        "last_value", changed("last_value", (kind == "time_series_trend") & (first == "l_quantity"),
                              F.col("evidence.last_value") + 0.5),
    ).withField(
        "outlier_count", changed("outlier_count", (kind == "outlier") & (first == "l_extendedprice"),
                                 F.col("evidence.outlier_count") + 1),
    ))


def checked(spark: SparkSession, folder: str, period: str = "all") -> DataFrame:
    """Discovered insights after tampering, verified against the results."""
    found, planned = results(spark, folder, period), plan(spark)

    def build() -> DataFrame:
        # Type by type: tables in buckets are joined where they lie, a union of them would be dealt again.
        return union(verify.verify(
            tampered(insights.discover(**{kind: df}, plan=planned, by=BY)), verify.actuals(**{kind: df}, by=BY), BY) for kind, df in found.items())

    with tasks_for(spark, sizes(spark, folder, period)["rows"]):
        return shared(spark, folder, f"checked-{period}", build, buckets(spark, folder))


def scored(spark: SparkSession, folder: str, period: str = "all") -> DataFrame:
    return ranking.with_score(ranking.with_confidence(checked(spark, folder, period)))


def top(spark: SparkSession, folder: str, period: str = "all") -> DataFrame:
    insights_ = scored(spark, folder, period)
    with tasks_for(spark, sizes(spark, folder, period)["rows"]):
        return shared(spark, folder, f"top-{period}", lambda: ranking.select_top(insights_, BY), buckets(spark, folder))


def columns_text(df: DataFrame) -> DataFrame:
    return df.withColumn("columns", F.array_join("source_columns", ","))


# --- SQL side -----------------------------------------------------------------------

_ORD = {**{("o", m): i + 1 for i, m in enumerate(MEASURES)}, **{("g", m): i + 4 for i, m in enumerate(MEASURES)},
        **{("t", m): i + 7 for i, m in enumerate(MEASURES)}, **{("c", p): i + 10 for i, p in enumerate(PAIRS)}}


def _by_measure(kind: str, column: str = "measure") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{m}' THEN {_ORD[kind, m]}" for m in MEASURES) + " END"


def _claim(alias: str, wrong: str, value: str) -> str:
    return f"CASE WHEN {wrong} THEN {value} ELSE {alias} END"


def decimal_sql(value: str) -> str:
    """12 significant digits of a value as an exact decimal."""
    return f"cast(cast(format('{{:.11e}}', cast({value} AS double)) AS double) AS decimal(18, 12))"


def four_places_sql(value: str) -> str:
    """A decimal rounded half to even at 4 places."""
    scaled = f"({value} * 10000)"
    return (
        f"cast(CASE WHEN {scaled} - floor({scaled}) = 0.5 THEN 2 * round({scaled} / 2.0, 0) ELSE round({scaled}, 0) END "
        f"AS double) / 10000")


def runs_sql(period: str = "all") -> str:
    """CTEs up to ``scored`` and ``top`` for the runs of one period (names carry the period)."""
    p = period
    long = " UNION ALL ".join(
        f"SELECT run_id, '{m}' AS measure, {m} AS value, l_returnflag AS flag, l_shipdate AS date, pos, n FROM base_{p}"
        for m in MEASURES)
    pairs = " UNION ALL ".join(
        f"SELECT run_id, '{a}' AS first, '{b}' AS second, {_ORD['c', (a, b)]} AS ord, count(*) AS n, "
        f"min({a}) < max({a}) AND min({b}) < max({b}) AS varies, regr_sxy({b}, {a}) AS sxy, "
        f"regr_sxx({b}, {a}) AS sxx, regr_syy({b}, {a}) AS syy FROM base_{p} GROUP BY run_id" for a, b in PAIRS)
    trend = trend_sql("run_id, measure").replace("trend AS", f"trend_{p} AS").replace("FROM points", f"FROM long_{p}")
    keys = "run_id, measure"
    return f"""
base_{p} AS (
  SELECT l_partkey AS run_id, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, {', '.join(LINE_ORDER)}) - 1 AS pos,
         count(*) OVER (PARTITION BY l_partkey) AS n
  FROM lineitem WHERE {PERIODS[p]}),
long_{p} AS ({long}),
desc_{p} AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
  FROM (SELECT {keys}, {quartile_sql('value', 0.25)} AS q1, {quartile_sql('value', 0.75)} AS q3 FROM long_{p} GROUP BY {keys})),
out_{p} AS (
  SELECT {keys}, lower_bound, upper_bound, count(*) FILTER (value < lower_bound OR value > upper_bound) AS outlier_count
  FROM long_{p} JOIN desc_{p} USING ({keys}) GROUP BY ALL),
cells_{p} AS (
  SELECT {keys}, flag, count(*) AS size, avg(value) AS mean, coalesce(var_samp(value), 0) AS v FROM long_{p} GROUP BY ALL),
grand_{p} AS (SELECT {keys}, sum(size * mean) / sum(size) AS g FROM cells_{p} WHERE size >= 2 GROUP BY {keys}),
gsum_{p} AS (
  SELECT {keys}, count(*) AS groups, count(*) FILTER (size >= 2) AS k, sum(size) FILTER (size >= 2) AS nn, min(size) AS smallest,
         sum(size * (mean - g) * (mean - g)) FILTER (size >= 2) AS ssb, sum((size - 1) * v) FILTER (size >= 2) AS ssw,
         arg_max(flag, (canon, -ascii(flag))) AS highest_group, arg_max(mean, (canon, -ascii(flag))) AS highest_value,
         arg_min(flag, (canon, flag)) AS lowest_group, arg_min(mean, (canon, flag)) AS lowest_value
  FROM (SELECT *, cast(format('{{:.11e}}', mean) AS double) AS canon FROM cells_{p}) LEFT JOIN grand_{p} USING ({keys}) GROUP BY {keys}),
f_{p} AS (
  SELECT *, highest_value - lowest_value AS absolute_difference,
         (highest_value - lowest_value) / nullif(abs(lowest_value), 0) * 100 AS percentage_difference,
         CASE WHEN smallest >= 3 AND k >= 2 AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (nn - k)) END AS f FROM gsum_{p}),
r_{p} AS (
  SELECT *, CASE WHEN n >= 2 AND varies THEN greatest(-1, least(1, sxy / sqrt(sxx * syy))) END AS c FROM ({pairs})),
in_{p} AS (
  SELECT 'g' || run_id || measure AS id, (nn - k) / 2.0 AS a, (k - 1) / 2.0 AS b, (nn - k) / (nn - k + (k - 1) * f) AS x,
         (k - 1) * f / (nn - k + (k - 1) * f) AS y FROM f_{p} WHERE f IS NOT NULL
  UNION ALL
  SELECT 'c' || run_id || first || second, n / 2.0 - 1, 0.5, 1 - c * c, c * c FROM r_{p} WHERE n > 2 AND abs(c) < 1),
{beta_sql(f'in_{p}', f'beta_{p}', 100)},
gtest_{p} AS (SELECT f.*, CASE WHEN f.f = 0 THEN 1.0 ELSE b.p END AS p FROM f_{p} f LEFT JOIN beta_{p} b ON b.id = 'g' || run_id || measure),
ctest_{p} AS (
  SELECT r.*, CASE WHEN n = 2 THEN 1.0 WHEN abs(c) = 1 THEN 0.0 WHEN c = 0 THEN 1.0 ELSE b.p END AS p
  FROM r_{p} r LEFT JOIN beta_{p} b ON b.id = 'c' || run_id || first || second WHERE c IS NOT NULL),
{trend},
found_{p} AS (
  SELECT run_id, 'group_difference' AS insight_type, {_by_measure('g')} AS ord, highest_group || ' has the highest average ' || measure AS title,
         measure || ',l_returnflag' AS columns, measure AS first, 'l_returnflag' AS second, 'group_mean_comparison' AS method,
         percentage_difference AS effect, p, nn AS sample_size, smallest, highest_value, highest_group, lowest_value, lowest_group,
         absolute_difference, f AS statistic, NULL::double AS r_squared, NULL AS direction, NULL AS strength,
         NULL::double AS first_value, NULL::double AS last_value, NULL AS first_date, NULL AS last_date,
         NULL::bigint AS outlier_count, NULL::double AS lower_bound, NULL::double AS upper_bound
  FROM gtest_{p} WHERE groups >= 2
  UNION ALL
  SELECT run_id, 'time_series_trend', {_by_measure('t')},
         measure || ' shows a ' || CASE WHEN trend_direction = 'flat' THEN 'stable' ELSE trend_direction END || ' trend over l_shipdate',
         measure || ',l_shipdate', measure, 'l_shipdate', 'deterministic_time_series_trend', percentage_change, NULL, sample_size, NULL,
         NULL, NULL, NULL, NULL, NULL, NULL, r_squared, trend_direction, trend_strength, first_value, last_value,
         {label_sql('first_date')}, {label_sql('last_date')}, NULL, NULL, NULL FROM trend_{p}
  UNION ALL
  SELECT run_id, 'correlation', ord, first || ' and ' || second || ' have a ' ||
         CASE WHEN abs(c) >= 0.8 THEN 'strong' WHEN abs(c) >= 0.5 THEN 'moderate' ELSE 'weak' END || ' ' ||
         CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END || ' relationship',
         first || ',' || second, first, second, 'pearson_correlation', c, p, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END,
         CASE WHEN abs(c) >= 0.8 THEN 'strong' WHEN abs(c) >= 0.5 THEN 'moderate' ELSE 'weak' END,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM ctest_{p} WHERE abs(c) >= 0.3
  UNION ALL
  SELECT run_id, 'outlier', {_by_measure('o')}, 'Potential outliers detected in ' || measure, measure, measure, NULL,
         'iqr_outlier_detection', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, outlier_count, lower_bound, upper_bound
  FROM out_{p} WHERE outlier_count > 0),
checked_{p} AS (
  SELECT *,
    CASE insight_type
      WHEN 'correlation' THEN CASE WHEN sample_size < 3 THEN 'insufficient_data' WHEN second = 'l_discount' THEN 'failed'
        WHEN p < 0.05 THEN 'verified' ELSE 'not_significant' END
      WHEN 'group_difference' THEN CASE WHEN smallest < 3 THEN 'insufficient_data' WHEN p IS NULL THEN 'failed'
        WHEN first = 'l_discount' THEN 'failed' WHEN p < 0.05 THEN 'verified' ELSE 'not_significant' END
      WHEN 'time_series_trend' THEN CASE WHEN first = 'l_quantity' THEN 'failed' ELSE 'verified' END
      ELSE CASE WHEN first = 'l_extendedprice' THEN 'failed' ELSE 'verified' END END AS status,
    CASE insight_type
      WHEN 'correlation' THEN CASE WHEN sample_size >= 3 AND second = 'l_discount' THEN 'correlation' END
      WHEN 'group_difference' THEN CASE WHEN smallest >= 3 AND p IS NOT NULL AND first = 'l_discount' THEN 'highest_value' END
      WHEN 'time_series_trend' THEN CASE WHEN first = 'l_quantity' THEN 'last_value' END END AS mismatches,
    CASE WHEN insight_type = 'correlation' AND second = 'l_discount' THEN effect * 0.9 ELSE effect END AS claimed,
    outlier_count + CASE WHEN first = 'l_extendedprice' THEN 1 ELSE 0 END AS claimed_count
  FROM found_{p}),
parts_{p} AS (
  SELECT *, CASE WHEN status = 'verified' THEN 1.0 ELSE 0.0 END AS vs,
    CASE WHEN p IS NULL THEN 0 WHEN p < 0.001 THEN 1 WHEN p < 0.01 THEN 0.9 WHEN p < 0.05 THEN 0.75 WHEN p < 0.1 THEN 0.4 ELSE 0 END AS ps,
    CASE WHEN s IS NULL THEN 0 WHEN s < 5 THEN 0.2 WHEN s < 10 THEN 0.4 WHEN s < 30 THEN 0.6 WHEN s < 100 THEN 0.8 ELSE 1 END AS ss
  FROM (SELECT *, CASE WHEN insight_type = 'group_difference' THEN smallest ELSE sample_size END AS s FROM checked_{p})),
effect_{p} AS (
  SELECT *, CASE WHEN claimed IS NULL THEN 0 ELSE abs(claimed) END AS size FROM parts_{p}),
confident_{p} AS (
  SELECT *, CASE WHEN status IN ('failed', 'insufficient_data') THEN 0.0 ELSE {four_places_sql('raw')} END AS confidence
  FROM (SELECT *, {decimal_sql("""CASE insight_type
      WHEN 'correlation' THEN least(size, 1) * 0.30 + ps * 0.30 + ss * 0.20 + vs * 0.20
      WHEN 'group_difference' THEN least(size / 100, 1) * 0.30 + ps * 0.25 + ss * 0.25 + 0.20
      WHEN 'outlier' THEN 0.60 + vs * 0.40
      ELSE CASE WHEN direction = 'flat' THEN greatest(r_squared, 0.5) ELSE r_squared END * 0.30
           + least(size / 25, 1) * 0.30 + ss * 0.20 + vs * 0.20 END""")} AS raw FROM effect_{p})),
scored_{p} AS (
  SELECT * EXCLUDE (raw), CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS level,
         {four_places_sql('raw')} AS score
  FROM (SELECT * EXCLUDE (raw), {decimal_sql("""CASE insight_type
      WHEN 'correlation' THEN size * 0.45 + vs * 0.20 + confidence * 0.25 + 0.05
      WHEN 'group_difference' THEN least(size / 100, 1) * 0.45 + vs * 0.20 + confidence * 0.25 + 0.05
      WHEN 'outlier' THEN CASE WHEN claimed_count = 1 THEN 0.70 WHEN claimed_count <= 3 THEN 0.75 ELSE 0.80 END * 0.45
           + vs * 0.20 + confidence * 0.25 + 0.05
      ELSE least(size / 100, 1) * 0.40 + r_squared * 0.20 + vs * 0.15 + confidence * 0.20 + 0.025 END""")} AS raw FROM confident_{p})),
top_{p} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ord) AS rank
                 FROM scored_{p} WHERE status = 'verified') WHERE rank <= 10)"""


RUNS_SQL = f"WITH RECURSIVE {runs_sql()}"

# --- discovery ------------------------------------------------------------------------


@query("group_insights", f"""{RUNS_SQL}
SELECT run_id, title, columns, highest_group, {r('highest_value', 6, 'highest_value')}, lowest_group,
       {r('lowest_value', 6, 'lowest_value')}, {r('absolute_difference', 6, 'absolute_difference')},
       {r('effect', 6, 'percentage_difference')}, {r('statistic', 5, 'statistic')}, {r('p', 6, 'p_value')}
FROM found_all WHERE insight_type = 'group_difference'""")
def group_insights(spark: SparkSession, folder: str) -> DataFrame:
    found = columns_text(insights.group_insights(results(spark, folder)["groups"], BY))
    fields = ["highest_group", "highest_value", "lowest_group", "lowest_value", "absolute_difference",
              "percentage_difference", "statistic", "p_value"]
    return rounded(found.select("run_id", "title", "columns", *[f"evidence.{f}" for f in fields]), {
        "highest_value": 6, "lowest_value": 6, "absolute_difference": 6, "percentage_difference": 6,
        "statistic": 5, "p_value": 6})


@query("trend_insights", f"""{RUNS_SQL}
SELECT run_id, title, columns, direction AS trend_direction, strength AS trend_strength, first_date, last_date, first_value,
       last_value, {r('effect', 6, 'percentage_change')}, {r('r_squared', 6, 'r_squared')}, sample_size
FROM found_all WHERE insight_type = 'time_series_trend'""")
def trend_insights(spark: SparkSession, folder: str) -> DataFrame:
    found = columns_text(insights.trend_insights(results(spark, folder)["trends"], BY))
    fields = ["trend_direction", "trend_strength", "first_date", "last_date", "first_value", "last_value",
              "percentage_change", "r_squared", "sample_size"]
    return rounded(found.select("run_id", "title", "columns", *[f"evidence.{f}" for f in fields]), {
        "percentage_change": 6, "r_squared": 6})


@query("corr_insights", f"""{RUNS_SQL}
SELECT run_id, title, columns, {r('effect', 6, 'correlation')}, strength, direction, {r('p', 6, 'p_value')}, sample_size
FROM found_all WHERE insight_type = 'correlation'""")
def corr_insights(spark: SparkSession, folder: str) -> DataFrame:
    found = columns_text(insights.correlation_insights(results(spark, folder)["correlations"], BY))
    fields = ["correlation", "strength", "direction", "p_value", "sample_size"]
    return rounded(found.select("run_id", "title", "columns", *[f"evidence.{f}" for f in fields]),
                   {"correlation": 6, "p_value": 6})


@query("outlier_insights", f"""{RUNS_SQL}
SELECT run_id, title, columns, outlier_count, {r('lower_bound', 4, 'lower_bound')}, {r('upper_bound', 4, 'upper_bound')}
FROM found_all WHERE insight_type = 'outlier'""")
def outlier_insights(spark: SparkSession, folder: str) -> DataFrame:
    found = columns_text(insights.outlier_insights(results(spark, folder)["outliers"], BY))
    return rounded(found.select(
        "run_id", "title", "columns", "evidence.outlier_count", "evidence.lower_bound", "evidence.upper_bound"),
        {"lower_bound": 4, "upper_bound": 4})


@query("discover_all", f"{RUNS_SQL} SELECT run_id, ord, insight_type, title, columns, method FROM found_all")
def discover_all(spark: SparkSession, folder: str) -> DataFrame:
    return columns_text(discovered(spark, folder)).select(
        "run_id", "ord", "insight_type", "title", "columns", "method")


# --- verification ---------------------------------------------------------------------


def _verification(df: DataFrame) -> DataFrame:
    return columns_text(df).select(
        "run_id", "insight_type", "columns", F.col("verification.status").alias("status"),
        F.array_join(F.transform("verification.mismatches", lambda m: m["field"]), ",").alias("mismatches"))


def _verify_sql(condition: str) -> str:
    return f"{RUNS_SQL} SELECT run_id, insight_type, columns, status, mismatches FROM checked_all WHERE {condition}"


for _name, _kind in (("verify_corr", "correlation"), ("verify_group", "group_difference"),
                     ("verify_trend", "time_series_trend"), ("verify_outlier", "outlier")):
    query(_name, _verify_sql(f"insight_type = '{_kind}'"))(
        lambda spark, folder, kind=_kind: _verification(
            checked(spark, folder).filter(F.col("insight_type") == kind)))


@query("verify_all", f"""{RUNS_SQL}
SELECT insight_type, status, count(*) AS insights FROM checked_all GROUP BY ALL""")
def verify_all(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).groupBy("insight_type", F.col("verification.status").alias("status")).agg(
        F.count(F.lit(1)).alias("insights"))


@query("verify_join", f"""{RUNS_SQL}
SELECT run_id, insight_type, columns, CASE WHEN first <> 'l_quantity' THEN CASE insight_type
  WHEN 'outlier' THEN 'No matching descriptive statistics result found.' ELSE 'No matching analysis result found.' END END AS reason
FROM checked_all WHERE first <> 'l_quantity' OR status IN ('verified', 'not_significant')""")
def verify_join(spark: SparkSession, folder: str) -> DataFrame:
    # Results of one measure only: every other insight finds no partner.
    actual = verify.actuals(**results(spark, folder), by=BY).filter(F.col("source_columns")[0] == "l_quantity")
    out = verify.verify(tampered(discovered(spark, folder)), actual, BY)
    first = F.col("source_columns")[0]
    return columns_text(out).filter(
        (first != "l_quantity") | F.col("verification.status").isin("verified", "not_significant")
    ).select("run_id", "insight_type", "columns", F.col("verification.reason").alias("reason"))


@query("verified_only", f"{RUNS_SQL} SELECT run_id, insight_type, columns FROM checked_all WHERE status = 'verified'")
def verified_only(spark: SparkSession, folder: str) -> DataFrame:
    return columns_text(verify.verified_only(checked(spark, folder))).select("run_id", "insight_type", "columns")


# --- confidence, score, rank --------------------------------------------------------------


@query("confidence", f"""{RUNS_SQL}
SELECT run_id, insight_type, columns, {r('confidence', 4, 'score')}, level,
       CASE WHEN status IN ('failed', 'insufficient_data') THEN status END AS reason FROM scored_all""")
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(columns_text(ranking.with_confidence(checked(spark, folder))).select(
        "run_id", "insight_type", "columns", F.col("confidence.score").alias("score"),
        F.col("confidence.level").alias("level"), F.col("confidence.reason").alias("reason")), {"score": 4})


@query("scores", f"{RUNS_SQL} SELECT run_id, insight_type, columns, {r('score', 4, 'score')} FROM scored_all")
def scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(columns_text(scored(spark, folder)).select("run_id", "insight_type", "columns", "score"), {"score": 4})


@query("rank_insights", f"""{RUNS_SQL}
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ord) AS rank, title
FROM scored_all WHERE status = 'verified'""")
def rank_insights(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank(scored(spark, folder), BY).select("run_id", "rank", "title")


@query("dedupe_insights", f"{RUNS_SQL} SELECT run_id, insight_type, columns, ord, title FROM scored_all")
def dedupe_insights(spark: SparkSession, folder: str) -> DataFrame:
    once = scored(spark, folder)
    again = once.withColumns({"ord": F.col("ord") + 100, "title": F.concat(F.lit("again: "), "title")})
    return columns_text(ranking.deduplicate(once.unionByName(again), BY)).select(
        "run_id", "insight_type", "columns", "ord", "title")


@query("top_insights", f"{RUNS_SQL} SELECT run_id, rank, insight_type, title, {r('score', 4, 'score')} FROM top_all")
def top_insights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(top(spark, folder).select("run_id", "rank", "insight_type", "title", "score"), {"score": 4})


@query("exec_priority", f"{RUNS_SQL} SELECT run_id, rank, title FROM top_all WHERE rank BETWEEN 2 AND 4")
def exec_priority(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.priority_list(top(spark, folder)).select("run_id", "rank", "title")
