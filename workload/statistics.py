"""Descriptive statistics, groups, correlations and samples over the driver tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import close_sql
from vouch.functions.special import with_f_tail
from vouch.operators import correlation, describe, groups, ordering, quantiles
from vouch.session import materialise
from workload.registry import query, r, rounded, table, union, union_sql
from workload.tables import GAPPY_SQL, gappy

MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_tax"]


def quartile_sql(value: str, q: float) -> str:
    """Nearest-rank quantile."""
    return f"list_sort(list({value}))[cast(floor((count({value}) - 1) * {q} + 0.5) AS int) + 1]"


def beta_sql(source: str, name: str, steps: int = 300) -> str:
    """Recursive CTEs evaluating I_x(a, b) for the rows (id, a, b, x, y) of ``source`` as ``name``(id, p)."""
    return f"""
{name}_prep AS (
  SELECT id, x > (a + 1) / (a + b + 2) AS swap,
         CASE WHEN x > (a + 1) / (a + b + 2) THEN b ELSE a END AS a,
         CASE WHEN x > (a + 1) / (a + b + 2) THEN a ELSE b END AS b,
         CASE WHEN x > (a + 1) / (a + b + 2) THEN y ELSE x END AS x,
         CASE WHEN x > (a + 1) / (a + b + 2) THEN x ELSE y END AS y
  FROM {source} WHERE a > 0 AND b > 0 AND x > 0 AND y > 0),
{name}_cf AS (
  SELECT id, swap, a, b, x, y, 0 AS m, 1.0::double AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d,
         1 / (1 - (a + b) * x / (a + 1)) AS h FROM {name}_prep
  UNION ALL
  SELECT id, swap, a, b, x, y, m, 1 + odd / c1, 1 / (1 + odd * d1), h1 * (1 + odd / c1) / (1 + odd * d1)
  FROM (SELECT *, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) AS odd, h * c1 * d1 AS h1
        FROM (SELECT *, 1 + even / c AS c1, 1 / (1 + even * d) AS d1
              FROM (SELECT id, swap, a, b, x, y, m + 1 AS m, c, d, h,
                           (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS even
                    FROM {name}_cf WHERE m < {steps})))),
{name} AS (
  SELECT id, CASE WHEN swap THEN 1 - tail ELSE tail END AS p
  FROM (SELECT id, swap, exp(a * ln(x) + b * ln(y) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * h AS tail
        FROM {name}_cf WHERE m = {steps}))"""


# --- descriptive -----------------------------------------------------------------

_DESCRIBED = [("lineitem", c) for c in MEASURES] + [("events", "value"), ("documents", "n_chars")]
_DESC_DIGITS = {
    "mean": 4, "median": 4, "min": 4, "max": 4, "std": 4, "q1": 4, "q3": 4, "iqr": 4, "lower_bound": 4,
    "upper_bound": 4,
}


def _describe_sql(name: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS measure, count({c}) AS count, avg({c}) AS mean, median({c}) AS median, min({c}) AS min, "
        f"max({c}) AS max, stddev_samp({c}) AS std, {quartile_sql(c, 0.25)} AS q1, {quartile_sql(c, 0.75)} AS q3 FROM {name}")


_DESC_SQL = f"""
SELECT measure, count, {', '.join(r(c, d, c) for c, d in _DESC_DIGITS.items())}
FROM (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
      FROM ({union_sql(_describe_sql(n, c) for n, c in _DESCRIBED)}))"""


def _described(spark: SparkSession, folder: str, **form: int) -> DataFrame:
    parts = [
        describe.describe(table(spark, folder, "lineitem"), MEASURES, **form),
        describe.describe(table(spark, folder, "events"), ["value"], **form),
        describe.describe(table(spark, folder, "documents"), ["n_chars"], **form),
    ]
    return rounded(union(parts).drop("status"), _DESC_DIGITS)


@query("desc_stats", _DESC_SQL)
def desc_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _described(spark, folder)


@query("desc_stats_large", _DESC_SQL)
def desc_stats_large(spark: SparkSession, folder: str) -> DataFrame:
    return _described(spark, folder, direct_cells=0, group_rows=0)


@query("quartiles_nearest", union_sql(
    f"SELECT l_returnflag, '{c}' AS measure, count({c}) AS n, {r(quartile_sql(c, 0.25), 4, 'q1')}, "
    f"{r(f'median({c})', 4, 'median')}, {r(quartile_sql(c, 0.75), 4, 'q3')} FROM gappy GROUP BY l_returnflag"
    for c in [*MEASURES, "l_tax"]
).replace("SELECT", f"WITH {GAPPY_SQL} SELECT", 1))
def quartiles_nearest(spark: SparkSession, folder: str) -> DataFrame:
    # The search that large groups need, whatever the size of this table.
    return rounded(quantiles.order_statistics(
        gappy(spark, folder), [*MEASURES, "l_tax"], ["l_returnflag"], direct_cells=0, group_rows=0,
    ), {"q1": 4, "median": 4, "q3": 4})


_SKEWED_SQL = """skewed AS (
  SELECT CASE WHEN l_quantity < 40 THEN 'bulk' ELSE cast(l_partkey AS varchar) END AS lot, l_extendedprice, l_discount FROM lineitem)"""


@query("quartiles_skewed", union_sql(
    f"SELECT lot, '{c}' AS measure, count({c}) AS n, {r(quartile_sql(c, 0.25), 4, 'q1')}, "
    f"{r(f'median({c})', 4, 'median')}, {r(quartile_sql(c, 0.75), 4, 'q3')} FROM skewed GROUP BY lot"
    for c in ["l_extendedprice", "l_discount"]
).replace("SELECT", f"WITH {_SKEWED_SQL} SELECT", 1))
def quartiles_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """One lot holds four fifths of the lines and is searched, thousands of small ones are sorted."""
    lots = table(spark, folder, "lineitem").withColumn(
        "lot", F.when(F.col("l_quantity") < 40, F.lit("bulk")).otherwise(F.col("l_partkey").cast("string")))
    return rounded(quantiles.order_statistics(
        lots, ["l_extendedprice", "l_discount"], ["lot"], direct_cells=0, group_rows=1000), {"q1": 4, "median": 4, "q3": 4})


_FENCES_SQL = f"""
values_ AS (SELECT event_type AS key, 'value' AS measure, cast(value AS double) AS value FROM events
            UNION ALL SELECT lang, 'n_chars', cast(n_chars AS double) FROM documents),
quartiles AS (SELECT key, measure, {quartile_sql('value', 0.25)} AS q1, {quartile_sql('value', 0.75)} AS q3
              FROM values_ GROUP BY key, measure),
outliers AS (SELECT key, measure, value, count(*) AS n FROM values_ JOIN quartiles USING (key, measure)
             WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY key, measure, value)"""


def _outliers(spark: SparkSession, folder: str, **form: int) -> DataFrame:
    parts = []
    for name, key, measure in (("events", "event_type", "value"), ("documents", "lang", "n_chars")):
        df = table(spark, folder, name).select(F.col(key).alias("key"), measure)
        statistics = materialise(describe.describe(df, [measure], ["key"], **form), "fences")
        parts.append(describe.outlier_values(df, statistics, [measure], ["key"]))
    return union(parts)


@query("outlier_rows", f"WITH {_FENCES_SQL} SELECT key, measure, value, n FROM outliers")
def outlier_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _outliers(spark, folder)


@query("outlier_rows_large", f"WITH {_FENCES_SQL} SELECT key, measure, value, n FROM outliers")
def outlier_rows_large(spark: SparkSession, folder: str) -> DataFrame:
    return _outliers(spark, folder, direct_cells=0, group_rows=0)


@query("outlier_summary", f"""WITH {_FENCES_SQL}
SELECT key, measure, cast(sum(n) AS bigint) AS outlier_count FROM outliers GROUP BY key, measure""")
def outlier_summary(spark: SparkSession, folder: str) -> DataFrame:
    return describe.outlier_summary(_outliers(spark, folder), ["key"]).drop("outlier_digest")


# --- groups ----------------------------------------------------------------------

_GROUP_DIGITS = {"mean": 4, "median": 4, "min": 4, "max": 4}


_GROUP_SQL = f"WITH {GAPPY_SQL} " + union_sql(
    f"SELECT '{m}' AS measure, '{d}' AS dimension, {d} AS key, count({m}) AS count, {r(f'avg({m})', 4, 'mean')}, "
    f"{r(f'median({m})', 4, 'median')}, {r(f'min({m})', 4, 'min')}, {r(f'max({m})', 4, 'max')} FROM gappy GROUP BY {d}"
    for m in MEASURES for d in ("l_returnflag", "l_linestatus")
)


@query("group_stats", _GROUP_SQL)
def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(groups.group_statistics(
        gappy(spark, folder), MEASURES, ["l_returnflag", "l_linestatus"]).drop("variance"), _GROUP_DIGITS)


@query("group_stats_large", _GROUP_SQL)
def group_stats_large(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(groups.group_statistics(
        gappy(spark, folder), MEASURES, ["l_returnflag", "l_linestatus"], direct_cells=0, group_rows=0).drop("variance"), _GROUP_DIGITS)


def _anova_sql(view: str, measures: list[str], dimensions: list[str]) -> str:
    """CTEs: sizes per group, then F and its tail as ``tested``."""
    cells = union_sql(
        f"SELECT '{m}' AS measure, '{d}' AS dimension, cast({d} AS varchar) AS key, count({m}) AS n, avg({m}) AS mean, "
        f"var_samp({m}) AS v FROM {view} GROUP BY {d}" for m in measures for d in dimensions)
    return f"""
cells AS (SELECT *, CASE WHEN key IS NULL THEN 0 ELSE n END AS size FROM ({cells})),
grand AS (SELECT measure, dimension, sum(size * mean) / sum(size) AS g FROM cells WHERE size >= 2 GROUP BY ALL),
sums AS (
  SELECT measure, dimension, count(*) AS groups, count(*) FILTER (size >= 2) AS k, sum(size) FILTER (size >= 2) AS nn,
         min(size) AS smallest, sum(size * (mean - g) * (mean - g)) FILTER (size >= 2) AS ssb,
         sum((size - 1) * v) FILTER (size >= 2) AS ssw
  FROM cells JOIN grand USING (measure, dimension) GROUP BY measure, dimension),
f AS (
  SELECT *, measure || dimension AS id,
         CASE WHEN smallest >= 3 AND k >= 2 THEN (ssb / (k - 1)) / (ssw / (nn - k)) END AS f FROM sums),
beta_in AS (
  SELECT id, (nn - k) / 2.0 AS a, (k - 1) / 2.0 AS b, (nn - k) / (nn - k + (k - 1) * f) AS x,
         (k - 1) * f / (nn - k + (k - 1) * f) AS y FROM f WHERE f IS NOT NULL),
{beta_sql('beta_in', 'beta')},
tested AS (SELECT f.*, p FROM f LEFT JOIN beta USING (id))"""


@query("group_gate", f"""WITH RECURSIVE {GAPPY_SQL}, {_anova_sql('gappy', MEASURES, ['l_returnflag', 'l_linestatus', 'l_linenumber'])}
SELECT measure, dimension, groups, smallest AS minimum_group_size,
       CASE WHEN smallest < 3 THEN 'insufficient_data' WHEN k >= 2 THEN 'completed' ELSE 'no_test' END AS status FROM sums""")
def group_gate(spark: SparkSession, folder: str) -> DataFrame:
    table_ = groups.group_statistics(gappy(spark, folder), MEASURES, ["l_returnflag", "l_linestatus", "l_linenumber"],
        medians=False)
    return groups.anova(table_).select("measure", "dimension", "groups", "minimum_group_size", "status")


@query("anova", f"""
WITH RECURSIVE priced AS (SELECT l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, p_brand, p_type
                FROM lineitem JOIN part ON l_partkey = p_partkey),
{_anova_sql('priced', MEASURES, ['l_returnflag', 'l_linestatus', 'p_brand', 'p_type'])}
SELECT measure, dimension, k AS group_count, cast(nn AS bigint) AS sample_size, {r('f', 6, 'statistic')},
       {r('p', 7, 'p_value')}, p = 0 AS p_value_underflow FROM tested""")
def anova(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    priced = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    statistics = groups.group_statistics(priced, MEASURES, ["l_returnflag", "l_linestatus", "p_brand", "p_type"],
        medians=False)
    return rounded(groups.anova(statistics).select(
        "measure", "dimension", "group_count", "sample_size", "statistic", "p_value", "p_value_underflow",
    ), {"statistic": 6, "p_value": 7})


@query("group_bar", """
WITH g AS (SELECT p_brand AS key, avg(p_retailprice) AS mean, count(p_retailprice) AS count, median(p_retailprice) AS median,
                  min(p_retailprice) AS min, max(p_retailprice) AS max FROM part GROUP BY p_brand
           HAVING avg(p_retailprice) IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (ORDER BY mean DESC, key) AS best, count(*) OVER () AS total FROM g)
SELECT coalesce(key, 'Missing') AS label, """ + ", ".join(
    r(c, 4, c) for c in ("mean", "median", "min", "max")) + """, count, total AS total_groups,
       least(total, 12) AS displayed_groups, total > 12 AS sampled
FROM ranked WHERE total <= 12 OR best <= 6 OR best > total - 6""")
def group_bar(spark: SparkSession, folder: str) -> DataFrame:
    statistics = groups.group_statistics(table(spark, folder, "part"), ["p_retailprice"], ["p_brand"])
    return rounded(groups.bar_groups(statistics).select(
        "label", "mean", "median", "min", "max", "count", "total_groups", "displayed_groups", "sampled"), _GROUP_DIGITS)


# --- correlation -----------------------------------------------------------------

PAIRS = list(combinations(NUMBERS, 2))


@query("corr_matrix", f"""
WITH RECURSIVE {GAPPY_SQL},
pairs AS ({union_sql(
    f"SELECT '{a}' AS first, '{b}' AS second, regr_count({b}, {a}) AS n, regr_sxy({b}, {a}) AS sxy, "
    f"regr_sxx({b}, {a}) AS sxx, regr_syy({b}, {a}) AS syy FROM gappy" for a, b in PAIRS)}),
rs AS (SELECT first, second, n, first || second AS id, sxy / sqrt(sxx * syy) AS c FROM pairs),
beta_in AS (SELECT id, n / 2.0 - 1 AS a, 0.5::double AS b, 1 - c * c AS x, c * c AS y FROM rs),
{beta_sql('beta_in', 'beta')}
SELECT first, second, n AS sample_size, 'completed' AS status, {r('c', 8, 'correlation')}, {r('p', 7, 'p_value')}
FROM rs LEFT JOIN beta USING (id)""")
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(correlation.correlations(gappy(spark, folder), PAIRS).select(
        "first", "second", "sample_size", "status", "correlation", "p_value",
    ), {"correlation": 8, "p_value": 7})


@query("corr_wide", f"""
WITH cells AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::double AS v FROM embeddings),
kept AS (SELECT vec_id, i, v FROM cells WHERE abs(v) >= 0.01)
SELECT 'd' || a.i AS first, 'd' || b.i AS second, count(*) AS sample_size, 'completed' AS status, {r('corr(a.v, b.v)', 8, 'correlation')}
FROM kept a JOIN kept b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""")
def corr_wide(spark: SparkSession, folder: str) -> DataFrame:
    """All 2,016 pairs of the 64 dimensions of the embeddings, small values missing."""
    vectors = table(spark, folder, "embeddings").select(*[
        F.when(F.abs(value) >= 0.01, value).alias(f"d{i}") for i in range(64) for value in [F.get("embedding", F.lit(i)).cast("double")]])
    pairs = list(combinations([f"d{i}" for i in range(64)], 2))
    return rounded(correlation.correlations(vectors, pairs).select("first", "second", "sample_size", "status", "correlation"), {"correlation": 8})


@query("corr_pairs_complete", f"WITH {GAPPY_SQL} " + union_sql(
    f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS total_points FROM gappy"
    for a, b in PAIRS))
def corr_pairs_complete(spark: SparkSession, folder: str) -> DataFrame:
    return correlation.complete_pairs(gappy(spark, folder), PAIRS)


_ORDER_VIEW = """
view AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders)"""


@query("scatter_sample", f"""
WITH {_ORDER_VIEW},
placed AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
                  count(*) OVER () AS n FROM view WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL),
wanted AS (SELECT i AS sample_index, n, CASE WHEN n <= 200 THEN i ELSE round_even(i * (n - 1) / 199.0, 0) END AS pos
           FROM range(200) t(i), (SELECT max(n) AS n FROM placed) WHERE n > 200 OR i < n)
SELECT 'o_custkey' AS first, 'o_totalprice' AS second, cast(sample_index AS int) AS sample_index,
       cast(x AS double) AS x, y, w.n AS total_points, least(w.n, 200) AS displayed_points, w.n > 200 AS sampled
FROM placed p JOIN wanted w ON p.pos = w.pos""")
def scatter_sample(spark: SparkSession, folder: str) -> DataFrame:
    view = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "case when o_orderstatus <> 'P' then o_totalprice end as o_totalprice")
    return ordering.scatter_sample(view, [("o_custkey", "o_totalprice")], ["o_orderkey"], unique=True, direct_rows=0)


# --- scalar rules over columns ------------------------------------------------------


@query("tolerance_check", """
SELECT l_linenumber, count(*) AS claims,
       count(*) FILTER (abs(l_extendedprice - claimed) <=
         greatest(greatest(abs(l_extendedprice), abs(claimed)) * 1e-6, 1e-6)) AS matching
FROM (SELECT l_linenumber, l_extendedprice, l_extendedprice * (1 + (l_linenumber - 4) * 4e-7) AS claimed FROM lineitem)
GROUP BY l_linenumber""")
def tolerance_check(spark: SparkSession, folder: str) -> DataFrame:
    claimed = "l_extendedprice * (1 + (l_linenumber - 4) * 4e-7D)"
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count(F.when(F.expr(close_sql("l_extendedprice", f"({claimed})")), 1)).alias("matching"))


# Pairs of every outcome: a constant, a single value, no value at all, and a sound pair.
_ODD_PAIRS = [("fixed", "o_totalprice"), ("single", "o_totalprice"), ("nothing", "o_totalprice"), ("o_custkey", "o_totalprice")]
_ODD_COLUMNS = {
    "fixed": "cast(1 as double)", "single": "case when o_orderkey = (SELECT min(o_orderkey) FROM orders) then 2.0 end",
    "nothing": "cast(null as double)",
}


@query("corr_statuses", f"""
WITH odd AS (SELECT *, {', '.join(f'{e} AS "{c}"' for c, e in _ODD_COLUMNS.items())} FROM orders),
pairs AS ({union_sql(
    f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"coalesce(min({a}) < max({a}), false) AS varies, corr({b}, {a}) AS c FROM odd" for a, b in _ODD_PAIRS)})
SELECT first, second, n AS sample_size,
       CASE WHEN n < 2 THEN 'insufficient_data' WHEN NOT varies THEN 'insufficient_variation' ELSE 'completed' END AS status,
       CASE WHEN n < 2 THEN '{fixed.REASONS['few_pairs']}' WHEN NOT varies THEN '{fixed.REASONS['no_variation']}' END AS reason,
       {r('CASE WHEN n >= 2 AND varies THEN c END', 8, 'correlation')} FROM pairs""")
def corr_statuses(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    lowest = orders.agg(F.min("o_orderkey")).first()[0]
    odd = orders.withColumns({
        "fixed": F.lit(1.0), "single": F.when(F.col("o_orderkey") == lowest, F.lit(2.0)), "nothing": F.lit(None).cast("double")})
    return rounded(correlation.correlations(odd, _ODD_PAIRS).select(
        "first", "second", "sample_size", "status", "reason", "correlation"), {"correlation": 8})


@query("p_value_tails", f"""
SELECT l_orderkey, l_linenumber, {r('(1 + l_suppkey % 40) / 2.0 * log10(1 + 2 * l_quantity / (1 + l_suppkey % 40))', 6, 'minus_log_p')}
FROM lineitem""")
def p_value_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Tails of F with two degrees above, for which there is a closed form; on a log scale, so that small ones count."""
    cases = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("f"), F.lit(2.0).alias("d1"),
        (1 + F.col("l_suppkey") % 40).cast("double").alias("d2"))
    tails = with_f_tail(cases, "p", "f", "d1", "d2")
    return rounded(tails.select("l_orderkey", "l_linenumber", (-F.log10("p")).alias("minus_log_p")), {"minus_log_p": 6})


_CLAIMS_SQL = """
means AS (SELECT l_returnflag AS key, avg(l_quantity) AS mean, count(l_quantity) AS n, var_samp(l_quantity) AS variance FROM gappy GROUP BY l_returnflag),
claims AS (SELECT max(mean) AS top, min(mean) AS bottom FROM means)"""


@query("group_recount", "WITH " + GAPPY_SQL + "," + _CLAIMS_SQL + f"""
SELECT key, n AS count, {r('mean', 6, 'mean')}, {r('variance', 6, 'variance')} FROM means""")
def group_recount(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics from the rows around claimed means, all of which are wrong and one of which is missing."""
    view = gappy(spark, folder)
    table_ = materialise(groups.group_statistics(view, ["l_quantity"], ["l_returnflag"], medians=False), "claimed")
    wrong = table_.filter("key is not null").withColumn("mean", F.col("mean") * 1.5)
    return rounded(groups.recounted(view, wrong, ["l_quantity"], ["l_returnflag"]).select("key", "count", "mean", "variance"), {"mean": 6, "variance": 6})


@query("group_counterexamples", "WITH " + GAPPY_SQL + "," + _CLAIMS_SQL + f"""
SELECT key, {r('mean', 6, 'mean')}, 'highest' AS claim FROM means, claims WHERE mean > bottom""")
def group_counterexamples(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest group is claimed to be the highest too: all groups above it speak against that."""
    view = gappy(spark, folder)
    table_ = materialise(groups.group_statistics(view, ["l_quantity"], ["l_returnflag"], medians=False), "claimed")
    claims = groups.extremes(table_).withColumn("highest_value", F.col("lowest_value"))
    again = groups.recounted(view, table_, ["l_quantity"], ["l_returnflag"])
    return rounded(groups.counterexamples(claims, again).select("key", "mean", "claim"), {"mean": 6})
