"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import documents, fresh, materialise, text_or_empty
from workload.registry import query

# A digest is SHA-256 plus a second, unrelated hash and the length: two texts are merged
# only if all three agree, which is verified again on every level.
IDENTITY = ["text_sha256", "text_xxh64", "n_bytes"]


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: identity of its text, id, the run it starts in and a number of its own."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("text_xxh64"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row_no"),
    )


def tree_merge(rows: DataFrame, runs: int, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """Merge ``runs`` runs of digests to one: of each identity the id that stays and the group size.

    A run holds every identity once, with the id kept so far.  In each round, run ``r``
    joins run ``r // fan_in`` (``fan_in`` a power of two: that many binomial steps at a
    time), and the merge of the sorted members keeps one id per verified identity.  Runs
    are spread over tasks by digest, so no task holds a run, least of all the last one.
    A group of copies is one row per run, however large it is.
    """
    id_first = F.struct("doc_id", (-F.col("row_no")).alias("row_order"))
    merged = rows.groupBy("run", *IDENTITY).agg(
        (F.max(id_first) if keep == "largest" else F.min(F.struct("doc_id", "row_no"))).alias("stays"),
        F.count(F.lit(1)).alias("group_size"),
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy("run", *IDENTITY).agg(
            (F.max("stays") if keep == "largest" else F.min("stays")).alias("stays"),
            F.sum("group_size").alias("group_size"),
        )
    second = -F.col("stays.row_order") if keep == "largest" else F.col("stays.row_no")
    return merged.select(*IDENTITY, F.col("stays.doc_id").alias("keep_id"), second.alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, keep: str = "largest", runs: int = 512, fan_in: int = 8) -> DataFrame:
    """One row per document: which document of its group of equal texts stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.  Null text counts as empty;
    empty texts are a group like any other.  A null id is smaller than any other.  Of
    rows that repeat both id and text exactly one is kept.  An empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are not read.  ``runs`` is the number of
    runs that the input partitions are dealt to at first; it changes no result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = materialise(digests(docs).withColumn("run", F.col("run") % runs), "digests")
    best = materialise(tree_merge(rows, runs, keep, fan_in), "digest-run")
    return rows.join(best, IDENTITY).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "largest", runs: int = 512, fan_in: int = 8) -> DataFrame:
    """The documents that stay, one for each text, with all their columns."""
    def key(sha):
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), sha)

    name = fresh(docs, "row_key")
    decided = exact_dedup(docs, keep, runs, fan_in).filter("kept").select(key(F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, key(F.sha2(text_or_empty(), 256)))
    # the key is one column, so that repeated rows go by the shuffle of the join
    return rows.join(decided, name, "left_semi").dropDuplicates([name]).drop(name)


OP4_SQL = """
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW w AS (PARTITION BY body ORDER BY doc_id DESC NULLS LAST)
"""


@query("op4_exact_dedup", OP4_SQL)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))
