"""Time series over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.operators import series
from vouch.session import materialise
from workload.registry import query, r, rounded, table, union
from workload.tables import LINE_ORDER

# --- fixed points of the SQL side ---------------------------------------------------
_ORDER_POINTS = """
points AS (
  SELECT o_custkey, o_orderdate AS date, o_totalprice AS value,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
         count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""
_EVENT_POINTS = """
points AS (
  SELECT event_type, ts AS date, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""


def label_sql(date: str) -> str:
    return (
        f"CASE WHEN date_trunc('second', {date}) = {date} THEN strftime({date}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({date}, '%Y-%m-%dT%H:%M:%S.%f') END")


def trend_sql(key: str) -> str:
    """CTE ``trend`` over ``points`` (key, date, value, pos, n)."""
    return f"""
trend AS (
  SELECT *, last_value - first_value AS absolute_change,
         (last_value - first_value) / nullif(abs(first_value), 0) * 100 AS percentage_change,
         last_value - previous AS latest_period_change,
         (last_value - previous) / nullif(abs(previous), 0) * 100 AS latest_period_percentage_change,
         CASE WHEN abs(last_value - first_value) <= 0.01 * greatest(abs(peak_value), abs(trough_value), 1) THEN 'flat'
              WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend_direction,
         CASE WHEN abs(last_value - first_value) <= 0.01 * greatest(abs(peak_value), abs(trough_value), 1) THEN 'stable'
              WHEN r_squared >= 0.8 THEN 'strong' WHEN r_squared >= 0.5 THEN 'moderate' ELSE 'weak' END AS trend_strength
  FROM (
    SELECT {key}, max(n) AS sample_size, arg_min(value, pos) AS first_value, arg_max(value, pos) AS last_value,
           arg_min(date, pos) AS first_date, arg_max(date, pos) AS last_date,
           max(value) FILTER (pos = n - 2) AS previous, max(value) AS peak_value, min(value) AS trough_value,
           arg_max(date, (value, -pos)) AS peak_date, arg_min(date, (value, pos)) AS trough_date,
           avg(value) FILTER (pos >= n - 3) AS latest_moving_average,
           CASE WHEN regr_r2(value, pos) > 1e-24 THEN regr_slope(value, pos) ELSE 0 END AS slope, regr_intercept(value, pos) AS intercept,
           CASE WHEN min(value) = max(value) THEN 1.0 ELSE regr_r2(value, pos) END AS r_squared
    FROM points GROUP BY {key})
  WHERE sample_size >= 3)"""


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    moments = series.series_moments(table(spark, folder, "orders"), ["o_totalprice"], "o_orderdate", ["o_orderkey"], ["o_custkey"])
    return series.trends(moments, "o_orderdate", ["o_custkey"]).filter("status = 'completed'")


def _events(spark: SparkSession, folder: str, **form: int) -> DataFrame:
    return series.series_points(
        table(spark, folder, "events"), ["value"], "ts", ["event_id"], ["event_type"], unique=True, **form)


@query("ts_points", f"""
SELECT {label_sql('o_orderdate')} AS date, o_totalprice AS value,
       row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus <> 'P'""")
def ts_points(spark: SparkSession, folder: str) -> DataFrame:
    view = table(spark, folder, "orders").withColumn(
        "o_totalprice", F.expr("case when o_orderstatus <> 'P' then o_totalprice end"))
    points = series.series_points(view, ["o_totalprice"], "o_orderdate", ["o_orderkey"], unique=True, direct_rows=0)
    return points.select(series.date_label(F.col("date"), points.schema["date"].dataType).alias("date"), "value", "pos")


_LINE_KEY = ", ".join(LINE_ORDER)


@query("ts_trend", f"""
WITH points AS (
  SELECT l_suppkey, l_shipdate AS date, l_extendedprice AS value, count(*) OVER (PARTITION BY l_suppkey) AS n,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_partkey, {_LINE_KEY}) - 1 AS pos FROM lineitem),
{trend_sql('l_suppkey')}
SELECT l_suppkey, sample_size, {r('slope', 6, 'slope_per_observation')}, {r('intercept', 3, 'intercept')},
       {r('r_squared', 8, 'r_squared')} FROM trend""")
def ts_trend(spark: SparkSession, folder: str) -> DataFrame:
    # Rows repeat in full here; equal ones are exchangeable.
    moments = series.series_moments(
        table(spark, folder, "lineitem"), ["l_extendedprice"], "l_shipdate", ["l_partkey", *LINE_ORDER], ["l_suppkey"])
    return rounded(series.trends(moments, "l_shipdate", ["l_suppkey"]).filter("status = 'completed'").select(
        "l_suppkey", "sample_size", "slope_per_observation", "intercept", "r_squared",
    ), {"slope_per_observation": 6, "intercept": 3, "r_squared": 8})


_CHANGES = {
    "first_value": 2, "last_value": 2, "absolute_change": 2, "percentage_change": 4, "latest_period_change": 2,
    "latest_period_percentage_change": 4,
}


@query("ts_changes", f"""WITH {_ORDER_POINTS}, {trend_sql('o_custkey')}
SELECT o_custkey, {label_sql('first_date')} AS first_date, {label_sql('last_date')} AS last_date,
       {', '.join(r(c, d, c) for c, d in _CHANGES.items())} FROM trend""")
def ts_changes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_orders(spark, folder).select("o_custkey", "first_date", "last_date", *_CHANGES), _CHANGES)


@query("ts_peak_trough", f"""WITH {_EVENT_POINTS}, {trend_sql('event_type')}
SELECT event_type, {label_sql('peak_date')} AS peak_date, peak_value, {label_sql('trough_date')} AS trough_date,
       trough_value FROM trend""")
def ts_peak_trough(spark: SparkSession, folder: str) -> DataFrame:
    moments = series.series_moments(table(spark, folder, "events"), ["value"], "ts", ["event_id"], ["event_type"])
    return series.trends(moments, "ts", ["event_type"]).select(
        "event_type", "peak_date", "peak_value", "trough_date", "trough_value")


@query("ts_moving_avg", f"""WITH {_ORDER_POINTS}
SELECT o_custkey, {r('avg(value)', 3, 'latest_moving_average')} FROM points
WHERE n >= 3 AND pos >= n - 3 GROUP BY o_custkey""")
def ts_moving_avg(spark: SparkSession, folder: str) -> DataFrame:
    points = series.series_points(
        table(spark, folder, "orders"), ["o_totalprice"], "o_orderdate", ["o_orderkey"], ["o_custkey"], unique=True)
    return rounded(series.moving_average(points, ["o_custkey"]).select("o_custkey", "latest_moving_average"),
                   {"latest_moving_average": 3})


@query("ts_class", f"""WITH {_ORDER_POINTS}, {trend_sql('o_custkey')}
SELECT o_custkey, trend_direction, trend_strength FROM trend""")
def ts_class(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select("o_custkey", "trend_direction", "trend_strength")


_SAMPLE_SQL = f"""WITH {_EVENT_POINTS},
wanted AS (
  SELECT event_type, i AS sample_index, n, CASE WHEN n <= 240 THEN i ELSE floor(i * (n - 1) / 239.0 + 0.5) END AS pos
  FROM range(240) t(i), (SELECT DISTINCT event_type, n FROM points) WHERE n > 240 OR i < n)
SELECT event_type, cast(sample_index AS int) AS sample_index, p.pos, {label_sql('date')} AS date, value
FROM points p JOIN wanted w USING (event_type) WHERE p.pos = w.pos"""


def _sampled(points: DataFrame) -> DataFrame:
    return series.sample_series(points).select(
        "event_type", "sample_index", "pos",
        series.date_label(F.col("date"), points.schema["date"].dataType).alias("date"), "value")


@query("series_sample", _SAMPLE_SQL)
def series_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sampled(_events(spark, folder))


@query("series_sample_large", _SAMPLE_SQL)
def series_sample_large(spark: SparkSession, folder: str) -> DataFrame:
    return _sampled(_events(spark, folder, direct_rows=0))


# Numbers far from zero with little spread: sums of squares of such values keep no digit of it.
_FAR = 1_000_000_000
_FAR_SQL = f"""
SELECT 'orders' AS source, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS value FROM orders
UNION ALL
SELECT 'events', row_number() OVER (ORDER BY ts, event_id) - 1, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL"""


@query("trend_formulations", f"""
WITH near AS ({_FAR_SQL}),
levels AS (SELECT source, pos, value, unnest(['near', 'far']) AS place FROM near)
SELECT source, place, count(*) AS sample_size, {r('regr_slope(value, pos)', 6, 'slope_per_observation')}, {r('regr_slope(value, pos)', 6, 'slope_again')},
       {r('regr_r2(value, pos)', 6, 'r_squared')}, {r('regr_r2(value, pos)', 6, 'r_squared_again')},
       {r("avg(value) FILTER (pos >= total - 3) + any_value(CASE place WHEN 'far' THEN " + str(_FAR) + ".0 ELSE 0 END)", 2, 'latest_moving_average')}
FROM (SELECT *, count(*) OVER (PARTITION BY source, place) AS total FROM levels) GROUP BY source, place""")
def trend_formulations(spark: SparkSession, folder: str) -> DataFrame:
    """Trends of ``orders`` and ``events`` as they are and shifted by 1e9, from running moments and from exact sums."""
    parts = []
    for source, measure, date, key in (("orders", "o_totalprice", "o_orderdate", "o_orderkey"), ("events", "value", "ts", "event_id")):
        levels = table(spark, folder, source).select(date, key, F.inline(F.array(*[
            F.struct(F.lit(place).alias("place"), (F.col(measure) + F.lit(float(shift))).alias("v")) for place, shift in (("near", 0), ("far", _FAR))])))
        moments = materialise(series.series_moments(levels, ["v"], date, [key], ["place"], exact=True), "formulations")
        one, two = (series.trends(moments, date, ["place"], exact=e) for e in (False, True))
        again = two.select("place", F.col("slope_per_observation").alias("slope_again"), F.col("r_squared").alias("r_squared_again"))
        parts.append(one.join(again, "place").select(
            F.lit(source).alias("source"), "place", "sample_size", "slope_per_observation", "slope_again", "r_squared", "r_squared_again",
            "latest_moving_average"))
    digits = dict.fromkeys(("slope_per_observation", "slope_again", "r_squared", "r_squared_again"), 6)
    return rounded(union(parts), {**digits, "latest_moving_average": 2})
