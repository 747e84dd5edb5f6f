"""Session helpers: the shared folder, written intermediates and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may hold.  Every table checked against it is narrow
# (keys plus a few doubles), so the bound is about 20 MB.
BROADCAST_ROWS = 200_000
# Rows of a group, or values of a bucket, that one task may hold.
GROUP_ROWS = 100_000
# Rows that one task of a shuffle sorts or joins.
TASK_ROWS = 250_000

# Key that rows are dealt by, first of the ``by`` columns of dealt tables.  It is never null, so it
# joins by plain equality and a join finds both sides dealt.
DEAL = "_deal"

_local_folder: str | None = None
_intermediates: list[tuple[str, str]] = []
_tables: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster an
    intermediate on one machine's disk would be lost with that machine.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="vouch-")
    return _local_folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder for intermediates in the shared folder; ``release_intermediates`` deletes it."""
    path = f"{shared_folder(spark)}/vouch/{label}-{uuid.uuid4().hex}"
    _intermediates.append((spark.sparkContext.applicationId, path))
    return path


def materialise(df: DataFrame, label: str, compression: str = "snappy", buckets: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later uses read columns of the written table, so the plan behind it runs
    once and does not have to be recomputed when an executor is lost.  With ``buckets`` the
    table is written in so many of them by DEAL: what is grouped, sorted or joined by it
    and more needs no shuffle.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    written = df.write.option("compression", compression)
    if buckets:
        _tables[path] = f"vouch_{uuid.uuid4().hex}"
        written.bucketBy(buckets, DEAL).option("path", path).format("parquet").saveAsTable(_tables[path])
        return spark.table(_tables[path])
    written.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_intermediates(spark: SparkSession) -> int:
    """Delete the intermediates of this application; tables read from them are of no use afterwards."""
    own = [entry for entry in _intermediates if entry[0] == spark.sparkContext.applicationId]
    for entry in own:
        if entry[1] in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(entry[1])}")
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _intermediates.remove(entry)
    return len(own)


def together(df: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """Deal the rows by group, so that what is grouped by ``by`` and more needs no further shuffle.

    Raw rows are narrower than aggregation buffers, and map-side folding gains nothing where a
    group has few rows per task.  ``most`` is the size of the largest group: above GROUP_ROWS the
    table is returned as it is and folds map-side, so no group meets whole in one task.
    """
    return df.repartition(*by) if by and most <= GROUP_ROWS else df


def with_deal(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add DEAL, a hash of ``by``; rows of one group agree in it, also those of a null key."""
    return df.withColumn(DEAL, F.xxhash64(*by))


def tasks(spark: SparkSession, rows: int) -> int:
    """A task per TASK_ROWS of ``rows``, or more where the session has more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is written meanwhile get a task per TASK_ROWS of ``rows``, or more where the session has more.

    Fixed numbers of tasks would sort ever more rows each, and spill them.  Adaptive execution
    puts small ones together again.  Tables dealt by some of the columns they are joined by are
    joined where they lie.
    """
    wanted = {"spark.sql.shuffle.partitions": str(tasks(spark, rows)), "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    given = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in given.items():
            spark.conf.set(name, value)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``limit`` rows.

    ``df`` should be a written table: the check counts it.  A larger table is
    returned unmarked and joins by shuffle.
    """
    small = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df
