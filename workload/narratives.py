"""Explanations, guardrail, recommendations, reports and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import fixed, text
from vouch.functions.numbers import canonical, numbers_in
from vouch.operators import describe, explain, report
from vouch.session import DEAL, materialise, new_folder, tasks_for
from vouch.sources import reports
from vouch.sources import runs as run_tables
from workload.findings import BY, RUNS_SQL, buckets, checked, columns_text, runs_sql, scored, sizes, top
from workload.registry import query, r, rounded, table
from workload.tables import shared

NUMBER = fixed.NUMBER_PATTERN
MARKER = fixed.LIST_MARKER_PATTERN


def numbers_sql(value: str) -> str:
    """Numbers of a text as list of doubles."""
    return (
        f"list_transform(regexp_extract_all(regexp_replace({value}, '{MARKER}', '', 'g'), '{NUMBER}'), "
        f"lambda s: cast(s AS double))")


def number_text_sql(value: str) -> str:
    shown = f"format('{{:.12g}}', {value})"
    return f"CASE WHEN regexp_matches({shown}, '[.e]') THEN {shown} ELSE {shown} || '.0' END"


# --- the explanation boundary -----------------------------------------------------------


@query("evidence_boundary", f"""{RUNS_SQL}
SELECT run_id, insight_type, title, columns, method, status, 3 AS limitation_count,
       {r('claimed', 4, 'claimed')} FROM checked_all WHERE status = 'verified'""")
def evidence_boundary(spark: SparkSession, folder: str) -> DataFrame:
    boundary = explain.evidence_boundary(checked(spark, folder), BY)
    claimed = F.coalesce("evidence.correlation", "evidence.percentage_difference", "evidence.percentage_change")
    return rounded(columns_text(boundary).select(
        "run_id", "insight_type", "title", "columns", "method", F.col("verification.status").alias("status"),
        F.size("limitations").alias("limitation_count"), claimed.alias("claimed")), {"claimed": 4})


def _first_limitation(kind: str) -> str:
    return f"'Limitation: {fixed.LIMITATIONS[kind][0]}'"


_TEXT_SQL = f"""CASE insight_type
  WHEN 'time_series_trend' THEN concat_ws(' ',
    first || ' has a verified ' || strength || ' ' || direction || ' historical trend.',
    'The verified series moves from ' || {number_text_sql('first_value')} || ' on ' || first_date || ' to '
      || {number_text_sql('last_value')} || ' on ' || last_date || '.',
    'The verified overall percentage change is ' || {number_text_sql('effect')} || '%.',
    'The verified R-squared value is ' || {number_text_sql('r_squared')} || '.', {_first_limitation('time_series_trend')})
  WHEN 'correlation' THEN concat_ws(' ',
    'The verified correlation between ' || first || ' and ' || second || ' is ' || {number_text_sql('effect')} || '.',
    'The relationship is based on ' || sample_size || ' observations.', 'The verified p-value is ' || {number_text_sql('p')} || '.',
    'This relationship is an association and does not establish causation.', {_first_limitation('correlation')})
  WHEN 'group_difference' THEN concat_ws(' ',
    highest_group || ' has a verified average value of ' || {number_text_sql('highest_value')} || '.',
    lowest_group || ' has a verified average value of ' || {number_text_sql('lowest_value')} || '.',
    'The verified absolute difference is ' || {number_text_sql('absolute_difference')} || '.',
    'The verified percentage difference is ' || {number_text_sql('effect')} || '%.',
    'A difference between groups does not by itself establish causation.', {_first_limitation('group_difference')})
  ELSE concat_ws(' ', first || ' contains ' || outlier_count || ' verified IQR outlier observations.',
    'The verified IQR bounds are ' || {number_text_sql('lower_bound')} || ' to ' || {number_text_sql('upper_bound')} || '.',
    'An outlier is not automatically a data error and should be reviewed in business context.', {_first_limitation('outlier')})
  END"""


@query("explanations", f"""{RUNS_SQL}
SELECT run_id, rank, 'approved' AS status, regexp_replace(body, '{NUMBER}', '#', 'g') AS wording,
       len({numbers_sql('body')}) AS number_count, {r(f'list_sum({numbers_sql("body")})', 2, 'number_total')}
FROM (SELECT run_id, rank, {_TEXT_SQL} AS body FROM top_all)""")
def explanations(spark: SparkSession, folder: str) -> DataFrame:
    best = top(spark, folder)
    told = explain.explain_local(best, BY)
    keyed = told.join(best.select(*BY, *explain.KEY, "rank"), [*BY, *explain.KEY])
    numbers = numbers_in("explanation")
    # The wording and the numbers are compared apart: sums of doubles differ in the last bits.
    return rounded(keyed.select(
        "run_id", "rank", "status", F.regexp_replace("explanation", NUMBER, "#").alias("wording"),
        F.size(numbers).alias("number_count"),
        F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x).alias("number_total")), {"number_total": 2})


def candidates(insights: DataFrame) -> DataFrame:
    """Proposed texts: right numbers for trends, a wrong one for outliers, blank for correlations, none for groups."""
    kind = F.col("insight_type")
    proposal = (
        F.when(kind == "time_series_trend", F.concat(F.lit("It ends at "), F.col("evidence.last_value").cast("string")))
        .when(kind == "outlier", F.concat(F.lit("There are 98765 of them, not "), F.col("evidence.outlier_count").cast("string")))
        .when(kind == "correlation", F.lit("  "))
    )
    return insights.select(*BY, *explain.KEY, proposal.alias("text")).filter(F.col("text").isNotNull())


@query("guardrail", f"""{RUNS_SQL}
SELECT run_id, insight_type, columns,
       CASE WHEN status <> 'verified' THEN 'rejected' WHEN insight_type = 'time_series_trend' THEN 'approved'
            WHEN insight_type = 'group_difference' THEN 'unavailable' ELSE 'rejected' END AS status,
       CASE WHEN status <> 'verified' THEN 'insight_not_verified' WHEN insight_type = 'group_difference' THEN 'llm_unavailable'
            WHEN insight_type = 'correlation' THEN 'invalid_response' END AS reason,
       CASE WHEN status = 'verified' AND insight_type = 'outlier' THEN '98765.0' ELSE '' END AS unsupported_numbers
FROM checked_all""")
def guardrail(spark: SparkSession, folder: str) -> DataFrame:
    found = checked(spark, folder)
    judged = explain.check_candidates(found, candidates(found), BY)
    return columns_text(judged).select(
        "run_id", "insight_type", "columns", "status", "reason",
        F.array_join(F.transform("unsupported_numbers", lambda x: x.cast("string")), ",").alias("unsupported_numbers"))


@query("guardrail_unsupported", f"""
WITH said AS (SELECT doc_id, unnest({numbers_sql('text')}) AS value FROM documents),
allowed AS (
  SELECT doc_id, cast(n_chars AS double) AS value FROM documents UNION SELECT doc_id, cast(quality AS double) FROM labels
  UNION SELECT doc_id, cast(toxic AS double) FROM labels)
SELECT doc_id, value, count(*) AS n FROM said
WHERE NOT EXISTS (SELECT 1 FROM allowed WHERE allowed.doc_id = said.doc_id AND allowed.value = said.value)
GROUP BY doc_id, value""")
def guardrail_unsupported(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    allowed = documents.select("doc_id", F.col("n_chars").cast("double").alias("value"))
    for name in ("quality", "toxic"):
        allowed = allowed.unionByName(labels.select("doc_id", F.col(name).cast("double").alias("value")))
    return explain.unsupported_in(documents, allowed, ["doc_id"]).groupBy("doc_id", "value").agg(
        F.count(F.lit(1)).alias("n"))


@query("explanation_source", f"""{RUNS_SQL}
SELECT run_id, rank, 'approved' AS status,
       CASE WHEN insight_type = 'time_series_trend' AND rank <= 1 THEN 'llm' ELSE 'deterministic' END AS source FROM top_all""")
def explanation_source(spark: SparkSession, folder: str) -> DataFrame:
    best = top(spark, folder)
    return explain.explain_ranked(best, candidates(best), 1, BY).select(
        "run_id", "rank", "explanation.status", "explanation.source")


_ACTION_SQL = """CASE insight_type
  WHEN 'correlation' THEN 'Investigate the relationship between ' || first || ' and ' || second || ' before making policy or operational changes.'
  WHEN 'group_difference' THEN 'Investigate why ' || highest_group || ' differs from ' || lowest_group || ' and determine whether the difference requires operational action.'
  WHEN 'outlier' THEN 'Review the identified outlier records to determine whether they represent legitimate business events or data-quality issues.'
  ELSE 'Monitor ' || first || ' and investigate the business drivers behind the ' || direction || ' historical trend before making forecasts or operational changes.' END"""


@query("recommendations", f"{RUNS_SQL} SELECT run_id, rank, {_ACTION_SQL} AS action, 'medium' AS priority FROM top_all")
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return explain.recommend(top(spark, folder)).select(
        "run_id", "rank", "recommendation.action", "recommendation.priority")


# --- reports ----------------------------------------------------------------------------------


def finished(spark: SparkSession, folder: str) -> DataFrame:
    best = top(spark, folder)
    with tasks_for(spark, sizes(spark, folder)["rows"]):
        return shared(spark, folder, "finished", lambda: explain.recommend(explain.explain_ranked(best, by=BY)), buckets(spark, folder))


@query("report_rows", f"""{RUNS_SQL}
SELECT run_id, rank, insight_type, title, replace(columns, ',', ', ') AS source_columns, method, status AS verification_status,
       level AS confidence_level, {r('confidence', 4, 'confidence_score')}, {r('score', 4, 'priority_score')},
       'approved' AS explanation_status, regexp_replace({_TEXT_SQL}, '{NUMBER}', '#', 'g') AS explanation,
       {_ACTION_SQL} AS recommendation_action, 'medium' AS recommendation_priority FROM top_all""")
def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    done = finished(spark, folder)
    cells = report.report_cells(report.report_rows(done, done, done, BY), BY)
    return rounded(cells.drop(DEAL, "evidence", "limitations", "recommendation_reason").withColumn(
        "explanation", F.regexp_replace("explanation", NUMBER, "#")), {"confidence_score": 4, "priority_score": 4})


@query("report_files", f"""{RUNS_SQL}
SELECT cast(run_id AS varchar) AS run_id, cast(rank AS varchar) AS rank, insight_type, title, replace(columns, ',', ', ') AS source_columns, method,
       level AS confidence_level, {_ACTION_SQL} AS recommendation_action, 16 AS cells_equal FROM top_all""")
def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of all runs written as a CSV file text each and read back: in how many of the 16 columns a row is what was written."""
    done = finished(spark, folder)
    cells = report.report_cells(report.report_rows(done, done, done, BY), BY).drop(DEAL).withColumn("run_id", F.col("run_id").cast("string"))
    # Both what is written and what it is compared with.
    cells = materialise(cells, "report-cells")
    path = new_folder(spark, "reports")
    reports.write_reports(cells, path)
    back = reports.read_reports(spark, path)
    given = cells.select("run_id", F.col("rank").cast("string").alias("rank"), F.struct(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fixed.REPORT_COLUMNS]).alias("given"))
    equal = sum((F.col(c) == F.col(f"given.{c}")).cast("int") for c in fixed.REPORT_COLUMNS)
    return back.join(given, ["run_id", "rank"]).select(
        "run_id", "rank", "insight_type", "title", "source_columns", "method", "confidence_level", "recommendation_action", equal.alias("cells_equal"))


_EVIDENCE_SQL = {
    "correlation": ["correlation", "direction", "p_value", "sample_size", "strength"],
    "group_difference": [
        "absolute_difference", "highest_group", "highest_value", "lowest_group", "lowest_value", "p_value",
        "statistic", "statistical_test"],
    "outlier": ["lower_bound", "outlier_count", "upper_bound"],
    "time_series_trend": [
        "absolute_change", "first_date", "first_value", "last_date", "last_value", "latest_moving_average",
        "latest_period_change", "moving_average_window", "peak_date", "peak_value", "r_squared", "sample_size",
        "trend_direction", "trend_strength", "trough_date", "trough_value"],
}


@query("evidence_long", f"""{RUNS_SQL},
fields AS ({' UNION ALL '.join(f"SELECT '{k}' AS insight_type, unnest({v!r}) AS field" for k, v in _EVIDENCE_SQL.items())})
SELECT insight_type, field, count(*) AS n FROM top_all JOIN fields USING (insight_type) GROUP BY ALL
UNION ALL
SELECT insight_type, CASE insight_type WHEN 'group_difference' THEN 'percentage_difference' ELSE 'percentage_change' END, count(effect)
FROM top_all WHERE insight_type IN ('group_difference', 'time_series_trend') GROUP BY ALL HAVING count(effect) > 0
UNION ALL
SELECT insight_type, 'latest_period_percentage_change', count(latest_period_percentage_change)
FROM top_all t JOIN trend_all r ON t.run_id = r.run_id AND t.first = r.measure WHERE insight_type = 'time_series_trend' GROUP BY ALL""")
def evidence_long(spark: SparkSession, folder: str) -> DataFrame:
    best = top(spark, folder)
    rows = report.evidence_rows(best, [*BY, "insight_type"])
    return rows.groupBy("insight_type", "field").agg(F.count("value").alias("n"))


_MAIN_FIELD = {
    "correlation": "correlation", "outlier": "outlier_count", "group_difference": "percentage_difference",
    "time_series_trend": "percentage_change",
}


@query("evidence_values", f"""{RUNS_SQL}
SELECT run_id, rank, CASE insight_type {' '.join(f"WHEN '{k}' THEN '{f}'" for k, f in _MAIN_FIELD.items())} END AS field,
       {r("CASE WHEN insight_type = 'outlier' THEN claimed_count ELSE claimed END", 6, 'value')} FROM top_all
WHERE CASE WHEN insight_type = 'outlier' THEN claimed_count ELSE claimed END IS NOT NULL""")
def evidence_values(spark: SparkSession, folder: str) -> DataFrame:
    """The number each insight stands on, as its evidence row gives it."""
    rows = report.evidence_rows(top(spark, folder), [*BY, "insight_type"])
    main = F.create_map(*[F.lit(x) for pair in _MAIN_FIELD.items() for x in pair])
    found = rows.filter(F.col("field") == main[F.col("insight_type")])
    return rounded(found.select("run_id", "rank", "field", F.col("value").cast("double").alias("value")), {"value": 6})


@query("exec_metric", f"""{RUNS_SQL}
SELECT run_id, insight_type, columns,
  CASE WHEN insight_type = 'outlier' THEN 'Outliers' WHEN claimed IS NULL THEN 'Priority score'
       WHEN insight_type = 'correlation' THEN 'Correlation' WHEN insight_type = 'group_difference' THEN 'Difference'
       ELSE 'Overall change' END AS metric_label,
  {r("CASE WHEN insight_type = 'outlier' THEN claimed_count WHEN claimed IS NULL THEN score "
     "WHEN insight_type = 'group_difference' THEN abs(claimed) ELSE claimed END", 6, 'metric_value')} FROM scored_all""")
def exec_metric(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(columns_text(report.headline_metric(scored(spark, folder))).select(
        "run_id", "insight_type", "columns", "metric_label", "metric_value"), {"metric_value": 6})


_LEVELS_SQL = ", ".join(f"count(*) FILTER (level = '{name}') AS {name}" for name in report.LEVELS)


@query("exec_summary", f"""{RUNS_SQL}
SELECT insight_type, count(*) AS verified_signals, {_LEVELS_SQL} FROM top_all GROUP BY insight_type""")
def exec_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.run_summary(top(spark, folder), ["insight_type"]).drop("top_title", "top_score")


@query("run_summary", f"""{RUNS_SQL}
SELECT run_id, count(*) AS verified_signals, {_LEVELS_SQL}, arg_min(title, rank) AS top_title,
       {r('arg_min(score, rank)', 4, 'top_score')} FROM top_all GROUP BY run_id""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(report.run_summary(top(spark, folder), BY).drop(DEAL), {"top_score": 4})


# --- runs -------------------------------------------------------------------------------------


@query("run_compare", f"""WITH RECURSIVE {runs_sql('early')}, {runs_sql('late')},
joined AS (
  SELECT coalesce(b.run_id, a.run_id) AS run_id,
         coalesce(b.insight_type || '::' || b.method || '::' || replace(b.columns, ',', '::'),
                  a.insight_type || '::' || a.method || '::' || replace(a.columns, ',', '::')) AS key,
         CASE WHEN b.run_id IS NULL THEN 'added' WHEN a.run_id IS NULL THEN 'removed'
              WHEN abs(a.score - b.score) > 1e-9 OR abs(a.confidence - b.confidence) > 1e-9
                OR a.level <> b.level OR a.title <> b.title THEN 'changed' END AS change,
         b.title AS before_title, a.title AS after_title, {r('a.score - b.score', 4, 'score_delta')},
         {r('a.confidence - b.confidence', 4, 'confidence_delta')}
  FROM top_early b FULL OUTER JOIN top_late a
    ON b.run_id = a.run_id AND b.insight_type = a.insight_type AND b.columns = a.columns)
SELECT * FROM joined WHERE change IS NOT NULL""")
def run_compare(spark: SparkSession, folder: str) -> DataFrame:
    changes = report.compare_runs(top(spark, folder, "early"), top(spark, folder, "late"), BY)
    return rounded(changes.select(
        "run_id", "key", "change", "before_title", "after_title", "score_delta", "confidence_delta",
    ), {"score_delta": 4, "confidence_delta": 4})


@query("run_status", """
SELECT l_linenumber, CASE WHEN count(CASE WHEN l_linenumber < 6 THEN l_tax END) = 0 OR count(l_quantity) = 0
  THEN 'partially_completed' ELSE 'completed' END AS status FROM lineitem GROUP BY l_linenumber""")
def run_status(spark: SparkSession, folder: str) -> DataFrame:
    # The last lines of an order have no tax here, so one of their analyses fails.
    view = table(spark, folder, "lineitem").withColumn("l_tax", F.expr("case when l_linenumber < 6 then l_tax end"))
    outcome = describe.describe(view, ["l_quantity", "l_tax"], ["l_linenumber"])
    return run_tables.run_status(outcome, ["l_linenumber"])


_VERSION_SQL = """
SELECT o_custkey AS dataset_id, o_orderkey AS version_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders"""


def _version_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("version_id"),
        F.col("o_orderdate").alias("created_at"))


@query("version_numbers", _VERSION_SQL)
def version_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return run_tables.version_numbers(_version_log(spark, folder)).drop("created_at")


@query("version_numbers_large", _VERSION_SQL)
def version_numbers_large(spark: SparkSession, folder: str) -> DataFrame:
    return run_tables.version_numbers(_version_log(spark, folder), direct_rows=0).drop("created_at")


@query("run_history", """
SELECT o_custkey AS version_id, count(*) OVER (PARTITION BY o_custkey) AS run_count, o_orderkey AS run_id,
       o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders""")
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return run_tables.run_history(runs).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


# --- text rules over whole texts ------------------------------------------------------------------


@query("extract_numbers", f"""
SELECT doc_id, len(found) AS number_count, list_min(found) AS smallest, list_max(found) AS largest
FROM (SELECT doc_id, {numbers_sql('text')} AS found FROM documents)""")
def extract_numbers(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", numbers_in("text").alias("found"))
    return found.select(
        "doc_id", F.size("found").alias("number_count"), F.array_min("found").alias("smallest"),
        F.array_max("found").alias("largest"))


@query("canonical_numbers", """
SELECT l_linenumber, count(DISTINCT c) AS distinct_values, min(c) AS smallest, max(c) AS largest,
       count(*) FILTER (c = x) AS unchanged
FROM (SELECT l_linenumber, x, cast(format('{:.11e}', x) AS double) AS c
      FROM (SELECT l_linenumber, l_extendedprice / (l_quantity * 3) AS x FROM lineitem)) GROUP BY l_linenumber""")
def canonical_numbers(spark: SparkSession, folder: str) -> DataFrame:
    shares = table(spark, folder, "lineitem").select("l_linenumber", F.expr("l_extendedprice / (l_quantity * 3)").alias("x"))
    return shares.withColumn("c", canonical("x")).groupBy("l_linenumber").agg(
        F.count_distinct("c").alias("distinct_values"), F.min("c").alias("smallest"), F.max("c").alias("largest"),
        F.count(F.when(F.col("c") == F.col("x"), 1)).alias("unchanged"))


_ALL_TEXTS = """
texts AS (SELECT 'documents' AS origin, doc_id AS id, text AS body FROM documents
          UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
          UNION ALL SELECT 'pages', page_id, html FROM pages)"""


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    documents, talks, pages = (table(spark, folder, n) for n in ("documents", "conversations", "pages"))
    return documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body")).unionAll(
        talks.select(F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text")).unionAll(
        pages.select(F.lit("pages"), "page_id", "html"))


@query("spreadsheet_safe", f"""WITH {_ALL_TEXTS}
SELECT origin, id, regexp_matches(body, '^[=+\\-@\\t\\r]') AS guarded,
       md5(CASE WHEN regexp_matches(body, '^[=+\\-@\\t\\r]') THEN '''' || body ELSE coalesce(body, '') END) AS cell_md5 FROM texts""")
def spreadsheet_safe(spark: SparkSession, folder: str) -> DataFrame:
    cell = text.spreadsheet_safe(F.col("body"))
    return _texts(spark, folder).select("origin", "id", (cell != F.col("body")).alias("guarded"), F.md5(cell).alias("cell_md5"))


@query("plain_text", f"""WITH {_ALL_TEXTS}
SELECT origin, id, md5(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(body,
  '(?m)^#{{1,6}}\\s*', '', 'g'), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '(?m)^\\s*[-*]\\s+', '- ', 'g'), '---', ''),
  '^\\s+|\\s+$', '', 'g')) AS plain_md5 FROM texts""")
def plain_text(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("origin", "id", F.md5(text.plain_report_text(F.col("body"))).alias("plain_md5"))


@query("redact_text", f"""WITH {_ALL_TEXTS}
SELECT origin, id, clean <> body AS redacted, md5(clean) AS clean_md5
FROM (SELECT *, regexp_replace(replace(body, 'example.com', '[REDACTED]'), 'Bearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi') AS clean
      FROM texts)""")
def redact_text(spark: SparkSession, folder: str) -> DataFrame:
    clean = text.redact(F.col("body"), ["example.com"])
    return _texts(spark, folder).select("origin", "id", (clean != F.col("body")).alias("redacted"), F.md5(clean).alias("clean_md5"))
