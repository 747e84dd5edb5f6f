"""Rules and sources over whole driver tables: number and name rules, points, CSV scans, stored runs, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.numbers import finite
from vouch.functions.text import name_matches
from vouch.operators import insights, quantiles, report, series
from vouch.plans import planner
from vouch.plans.pipeline import analyse
from vouch.session import new_folder
from vouch.sources import uploads
from vouch.sources.runs import RunStore
from vouch.sources.tables import read_csv
from workload.profiling import CATALOGUE_SQL, lake_catalogue
from workload.registry import query, table
from workload.tables import GAPPY_SQL, gappy
from workload.timelines import label_sql


_TEXT = """CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN 'Infinity' WHEN o_orderkey % 11 = 0 THEN NULL
  ELSE concat(cast(o_orderkey AS {text}), '.5') END"""


@query("finite_numbers", f"""
SELECT o_orderkey, CASE WHEN isfinite(n) THEN n END AS number
FROM (SELECT o_orderkey, try_cast({_TEXT.format(text='varchar')} AS double) AS n FROM orders)""")
def finite_numbers(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("cell", F.expr(_TEXT.format(text="string")))
    return orders.select("o_orderkey", finite(F.col("cell")).alias("number"))


@query("date_labels", f"""
SELECT o_orderkey, {label_sql('o_orderdate')} AS day, strftime(cast(o_orderdate AS date), '%Y-%m-%d') AS plain FROM orders""")
def date_labels(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    kind = orders.schema["o_orderdate"].dataType
    days = orders.withColumn("d", F.to_date("o_orderdate"))
    return days.select(
        "o_orderkey", series.date_label(F.col("o_orderdate"), kind).alias("day"),
        series.date_label(F.col("d"), days.schema["d"].dataType).alias("plain"))


@query("name_match", "SELECT p_partkey, regexp_matches(lower(trim(p_type)), '(?:steel)|(?:^l)') AS matches FROM part")
def name_match(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", name_matches(F.col("p_type"), ["steel", "^l"]).alias("matches"))


@query("drop_nulls", f"""WITH {GAPPY_SQL}
SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS value FROM gappy WHERE l_discount IS NOT NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM gappy WHERE l_tax IS NOT NULL""")
def drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.long_form(gappy(spark, folder), ["l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])


@query("minimum_sample", f"""
SELECT o_custkey, o_orderpriority, count(*) AS sample_size, CASE WHEN count(*) >= 3 THEN 'completed' ELSE 'insufficient_data' END AS status,
       CASE WHEN count(*) < 3 THEN '{fixed.REASONS['short_series']}' END AS reason
FROM orders GROUP BY o_custkey, o_orderpriority""")
def minimum_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer by priority: long and short series."""
    keys = ["o_custkey", "o_orderpriority"]
    moments = series.series_moments(table(spark, folder, "orders"), ["o_totalprice"], "o_orderdate", ["o_orderkey"], keys)
    return series.trends(moments, "o_orderdate", keys).select(*keys, "sample_size", "status", "reason")


@query("insight_keys", """
SELECT l_orderkey, l_linenumber, l_returnflag || '::' || l_linestatus || '::' || l_linenumber || '::' || l_suppkey AS run_key FROM lineitem""")
def insight_keys(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("insight_type"), F.col("l_linestatus").alias("method"),
        F.array(F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("source_columns"))
    return lines.select("l_orderkey", "l_linenumber", report.run_key().alias("run_key"))


@query("contract", """
SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AS holds FROM orders""")
def contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", *[
        f"case when o_orderkey % {n} <> 0 then '{c}' end as {c}" for n, c in ((3, "insight_type"), (4, "title"), (5, "method"))])
    return rows.select("o_orderkey", insights.contract_holds().alias("holds"))


@query("eligibility", f"""WITH {CATALOGUE_SQL}
SELECT table_name, "column" FROM catalogue WHERE regexp_matches(dtype, '^(int|float)') AND role IN ('measure', 'numeric')""")
def eligibility(spark: SparkSession, folder: str) -> DataFrame:
    return planner.correlation_columns(lake_catalogue(spark, folder)).select("table_name", "column")


@query("csv_scan", "SELECT c_custkey, c_name, cast(c_nationkey AS bigint) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table written as CSV and read again with inferred types."""
    path = new_folder(spark, "csv")
    table(spark, folder, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("csv_scan_texts", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def csv_scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with line breaks and quotes, written as CSV and read again by all tasks."""
    path = new_folder(spark, "csv")
    table(spark, folder, "documents").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path)


@query("run_lookup", """
SELECT lpad(cast(c_nationkey AS varchar), 3, '0') AS run_id, c_custkey, c_acctbal FROM customer""")
def run_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Customers stored as runs by nation, with ids such as 007, and read back from the store."""
    store = RunStore(spark, new_folder(spark, "runs"))
    rows = table(spark, folder, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("run_id"), "c_custkey", "c_acctbal")
    store.write_stage("customers", rows.repartition("run_id"))
    return store.read_stage("customers").select("run_id", "c_custkey", "c_acctbal")


# Customers in one uploaded file: about 10 MB, whatever the size of the table.
UPLOAD_ROWS = 200_000


@query("upload_triage", """
SELECT c_mktsegment AS folder, count(*) > 0 AS accepted, CAST(NULL AS varchar) AS reason FROM customer GROUP BY 1
UNION ALL SELECT DISTINCT 'text', false, 'Only CSV and Excel files are supported.' FROM customer""")
def upload_triage(spark: SparkSession, folder: str) -> DataFrame:
    """Customers uploaded as one CSV folder per segment, and all of them as text, in files of bounded size; the verdicts of each folder."""
    path = new_folder(spark, "uploads")
    customers = table(spark, folder, "customer")
    bounded = {"maxRecordsPerFile": UPLOAD_ROWS}
    customers.withColumn("folder", F.col("c_mktsegment")).write.partitionBy("folder").options(header=True, **bounded).csv(path)
    customers.select("c_name").write.options(**bounded).text(f"{path}/folder=text")
    found = uploads.triage(spark, path)
    name = F.regexp_extract("path", "folder=([^/]+)/", 1)
    return found.filter("name like 'part-%'").select(name.alias("folder"), "accepted", "reason").distinct()


# Lines of files that are told apart only by reading their first records.
_ODD_FILES = {"wide": ["a,b", "1,2,3"], "quoted": ["a,b", '"x', 'y,z",1'], "nul": ["\0a,b"], "empty": [""], "open": ["a,b", '1,"x']}


@query("upload_files", f"""
SELECT 'nation-' || c_nationkey || '-' || c_mktsegment AS folder, true AS accepted, CAST(NULL AS varchar) AS reason
FROM (SELECT c_nationkey, c_mktsegment, unnest(range(cast(ceil(count(*) / {UPLOAD_ROWS}.0) AS bigint))) FROM customer GROUP BY 1, 2)
UNION ALL
SELECT kind || '-' || n_nationkey, kind = 'quoted', CASE WHEN kind <> 'quoted' THEN 'The file content does not match its extension.' END
FROM nation, (SELECT unnest({list(_ODD_FILES)}) AS kind)""")
def upload_files(spark: SparkSession, folder: str) -> DataFrame:
    """One verdict per file: customers by nation and segment, and per nation a file of each odd kind."""
    path = new_folder(spark, "uploads")
    customers = table(spark, folder, "customer")
    named = customers.withColumn("folder", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")))
    named.repartition("folder").write.partitionBy("folder").options(header=True, maxRecordsPerFile=UPLOAD_ROWS).csv(path)
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("at"), F.lit(line).alias("line")) for kind, rows in _ODD_FILES.items() for i, line in enumerate(rows)])
    odd = table(spark, folder, "nation").select("n_nationkey", F.inline(lines)).withColumn(
        "folder", F.concat("kind", F.lit("-"), F.col("n_nationkey").cast("string")))
    odd.repartition("folder").sortWithinPartitions("folder", "at").select("folder", "line").write.mode("append").partitionBy("folder").options(
        header=False, sep="\u0001", quote="\u0002", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    found = uploads.triage(spark, path)
    return found.filter("name like 'part-%'").select(F.url_decode(F.regexp_extract("path", "folder=([^/]+)/", 1)).alias("folder"), "accepted", "reason")


@query("run_by_id", """
SELECT '007' AS run_id, c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7""")
def run_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """One run of the store, read from its own partition."""
    store = RunStore(spark, new_folder(spark, "runs"))
    rows = table(spark, folder, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("run_id"), "c_custkey", "c_acctbal")
    store.write_stage("customers", rows.repartition("run_id"))
    return store.read_stage("customers", "007").select("run_id", "c_custkey", "c_acctbal")


@query("whole_run", """
SELECT 'analysis' AS what, * FROM (VALUES
  ('descriptive_statistics', 'o_totalprice', 'completed'), ('group_comparison', 'o_totalprice,o_orderstatus', 'completed'),
  ('group_comparison', 'o_totalprice,o_orderpriority', 'completed'), ('time_series', 'o_totalprice,o_orderdate', 'completed'),
  ('correlation', 'o_custkey,o_orderkey', 'completed'), ('correlation', 'o_orderkey,o_totalprice', 'completed'),
  ('correlation', 'o_custkey,o_totalprice', 'completed')) AS t(kind, columns, status)
UNION ALL SELECT 'lineage', 'sales', 'v1,whole', 'completed'""")
def whole_run(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run over ``orders``: what was analysed, and the lineage all its insights carry."""
    run = analyse(table(spark, folder, "orders"), run_id="whole", dataset_id="sales", version_id="v1", order_by=["o_orderkey"], unique=True)
    pair = F.array_join(F.array_sort(F.array("first", "second")), ",")
    done = run.outcomes.select(
        F.lit("analysis").alias("what"), F.col("type").alias("kind"),
        F.when(F.col("first").isNotNull(), pair).otherwise(F.concat_ws(",", "measure", "dimension", "date")).alias("columns"), "status")
    lineage = run.insights.select(F.lit("lineage").alias("what"), F.col("lineage.dataset_id").alias("kind"), F.concat_ws(
        ",", "lineage.version_id", "lineage.run_id").alias("columns"), F.lit(run.status).alias("status")).distinct()
    return done.unionByName(lineage)
