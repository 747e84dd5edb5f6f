"""What the operators share: reading documents, written intermediates, row keys, batches of columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vouch.session import materialise

__all__ = ["documents", "fresh", "give_back", "id_text", "keyed", "map_batches", "materialise", "partitions", "row_key", "text_or_empty"]

# Bytes of text a Python worker turns into arrays at a time.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty; other columns are left out, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def row_key() -> Column:
    """A key that is equal for rows that agree in id and text and for no others."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), text_or_empty()))


def keyed(docs: DataFrame) -> DataFrame:
    """``id_text`` with ``row_key``: repeated rows get the same answers, so they may share a key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), row_key().alias("row_key"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, its allocators would keep the most that one of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str | StructType,
                limit: int = BATCH_BYTES, kept: list | None = None) -> DataFrame:
    """``mapInArrow`` over slices of about ``limit`` bytes: a batch of long texts is worked off in parts.

    ``kept`` is what ``work`` keeps between slices; it goes with the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
                for start in range(0, batch.num_rows, step):
                    yield from work(batch.slice(start, step)) or ()
                    give_back()
        finally:
            if kept is not None:
                kept.clear()
            give_back()

    return df.mapInArrow(run, schema)
