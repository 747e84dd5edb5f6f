"""Driver tables, views derived from them and tables shared by several queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.session import materialise
from workload.registry import table

# Column types of the driver tables, as the catalogue names them.
TABLES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "int32", "r_name": "str"},
    "nation": {"n_nationkey": "int32", "n_name": "str", "n_regionkey": "int32"},
    "customer": {
        "c_custkey": "int64", "c_name": "str", "c_nationkey": "int32", "c_acctbal": "float64",
        "c_mktsegment": "str",
    },
    "supplier": {"s_suppkey": "int64", "s_name": "str", "s_nationkey": "int32", "s_acctbal": "float64"},
    "part": {
        "p_partkey": "int64", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int32",
        "p_retailprice": "float64",
    },
    "orders": {
        "o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "str", "o_totalprice": "float64",
        "o_orderdate": "timestamp", "o_orderpriority": "str",
    },
    "lineitem": {
        "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int32",
        "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64",
        "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "timestamp",
    },
    "events": {
        "event_id": "int64", "ts": "timestamp", "user_id": "int64", "event_type": "str", "value": "float64",
        "props": "str",
    },
    "documents": {"doc_id": "int64", "text": "str", "lang": "str", "source": "str", "n_chars": "int64"},
    "embeddings": {"vec_id": "int64", "embedding": "array<float>", "label": "int32"},
    "pages": {"page_id": "int64", "url": "str", "html": "str"},
    "benchmark": {"item_id": "int64", "text": "str"},
    "labels": {"doc_id": "int64", "quality": "int32", "toxic": "int32"},
    "conversations": {"conv_id": "int64", "turn": "int64", "role": "str", "text": "str"},
}

LINE_ORDER = [
    "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]

_written: dict[tuple, DataFrame] = {}


def file_state(spark: SparkSession, folder: str) -> tuple:
    """Number, size and newest change of the files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string")).first())


def shared(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], buckets: int = 0) -> DataFrame:
    """A table several queries start from, written once per session and state of the folder."""
    key = (spark.sparkContext.applicationId, folder, name, file_state(spark, folder))
    if key not in _written:
        _written[key] = materialise(build(), name, "zstd", buckets)
    return _written[key]


def forget_shared() -> None:
    """Drop the list of shared tables, so that the next query builds its own."""
    _written.clear()


# A view with missing cells: the driver tables have none.
GAPPY_SQL = """
gappy AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
         nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with zero discounts, zero taxes and flag N missing."""
    lines = table(spark, folder, "lineitem")
    return lines.withColumns({
        "l_discount": F.expr("nullif(l_discount, 0D)"), "l_tax": F.expr("nullif(l_tax, 0D)"),
        "l_returnflag": F.expr("nullif(l_returnflag, 'N')"),
    })


CONTACTS_SQL = """
contacts AS (
  SELECT c_custkey AS row_no, c_name AS customer_name,
         lower(replace(c_name, '#', '.')) || '@example.com' AS contact,
         CASE WHEN c_acctbal >= 0 THEN 6000000000 + c_custkey ELSE c_custkey END AS hotline,
         lpad(cast(c_nationkey AS varchar), 4, '0') || ' 1234 ' || lpad(cast(c_custkey % 10000 AS varchar), 4, '0') AS reference,
         'Company ' || cast(c_nationkey AS varchar) AS company,
         c_mktsegment AS segment, c_acctbal AS balance
  FROM customer)"""


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """customer as a contact list: personal data under telling and under neutral names."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey as row_no", "c_name as customer_name",
        "lower(replace(c_name, '#', '.')) || '@example.com' as contact",
        "case when c_acctbal >= 0 then 6000000000 + c_custkey else c_custkey end as hotline",
        "lpad(cast(c_nationkey as string), 4, '0') || ' 1234 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') as reference",
        "'Company ' || cast(c_nationkey as string) as company",
        "c_mktsegment as segment", "c_acctbal as balance",
    )


CONTACT_COLUMNS = {
    "row_no": "int64", "customer_name": "str", "contact": "str", "hotline": "int64", "reference": "str",
    "company": "str", "segment": "str", "balance": "float64",
}
