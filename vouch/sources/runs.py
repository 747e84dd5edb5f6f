"""Run history as Parquet tables partitioned by run, and dataset version numbers."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.operators.ordering import DIRECT_ROWS, positions
from vouch.operators.quantiles import null_safe

STATUS_STAGE = "status"


def version_numbers(versions: DataFrame, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Number the versions of each dataset 1, 2, ... in creation order; ``version_id`` is unique.

    One dataset may hold most versions: positions are found without a task per dataset.
    """
    order = [F.col("created_at"), F.col("version_id")]
    others = {c: F.col(c) for c in versions.columns if c != "dataset_id"}
    placed = positions(versions, order, others, {"all": (F.lit(True), None)}, ["dataset_id"], unique=True,
        direct_rows=direct_rows)
    return placed.select(*versions.columns, (F.col("pos_all") + 1).alias("version_number"))


def duplicate_versions(versions: DataFrame) -> DataFrame:
    """(dataset_id, version_number, n) that occur more than once; empty when the log is sound."""
    return versions.groupBy("dataset_id", "version_number").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def run_status(results: DataFrame, by: list[str]) -> DataFrame:
    """(by..., status): partially_completed when any analysis of the run failed."""
    failed = F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False))
    return results.groupBy(*by).agg(
        F.when(failed, F.lit("partially_completed")).otherwise(F.lit("completed")).alias("status"))


def run_history(runs: DataFrame, version_id: str | None = None) -> DataFrame:
    """Runs newest first with the number of runs of their dataset version."""
    if version_id is not None:
        runs = runs.filter(F.col("version_id") == version_id)
    counts = runs.groupBy("version_id").agg(F.count(F.lit(1)).alias("run_count"))
    return null_safe(runs, counts, ["version_id"]).select(
        "version_id", "run_count", "run_id", "status", "created_at",
    ).orderBy("version_id", F.desc("created_at"), F.desc("run_id"))


class RunStore:
    """One Parquet table per stage under ``path``, partitioned by ``run_id``.

    Every stage is append-only.  A run is the set of its rows; its latest status
    row says how far it got, and is written after the stages it describes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _table(self, stage: str) -> str:
        return f"{self.path}/{stage}"

    def set_status(self, run_id: str, version_id: str, dataset_id: str | None, status: str) -> None:
        row = self.spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(version_id).alias("version_id"),
            F.lit(dataset_id).cast("string").alias("dataset_id"), F.lit(status).alias("status"),
            F.current_timestamp().alias("written_at"),
        )
        self.write_stage(STATUS_STAGE, row)

    def _schemas(self, stage: str) -> str:
        return f"{self.path}/_schemas/{stage}"

    def _stored_schema(self, stage: str) -> T.StructType | None:
        """Fields of all schemas written for a stage, run_id as text; null without any."""
        try:
            kept = self.spark.read.schema("schema string").json(self._schemas(stage)).distinct().collect()
        except AnalysisException:
            return None
        fields = {}
        for row in kept:
            fields |= {f.name: f for f in T.StructType.fromJson(json.loads(row["schema"])).fields}
        return T.StructType([*fields.values()]) if fields else None

    def write_stage(self, stage: str, df: DataFrame) -> None:
        """Append the rows of one stage; ``df`` carries ``run_id``, which is kept as text.

        The schema is stored beside the rows when it brings a new field, so that
        reading needs no look at the files of every run.
        """
        df = df.withColumn("run_id", F.col("run_id").cast("string"))
        known = self._stored_schema(stage)
        if known is None or not {f.name for f in df.schema.fields} <= set(known.names):
            self.spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("append").json(self._schemas(stage))
        df.write.mode("append").partitionBy("run_id").parquet(self._table(stage))

    def read_stage(
        self, stage: str, run_id: str | None = None, schema: T.StructType | None = None
    ) -> DataFrame:
        """All runs of a stage, or one run read from its own partition.

        The schema is the stored one or ``schema``; a run id such as 001 or 1e3 stays
        the text that it is.
        """
        schema = schema or self._stored_schema(stage)
        if schema is None:
            raise LookupError(f"No run has written the stage {stage}")
        df = self.spark.read.schema(schema).parquet(self._table(stage))
        return df if run_id is None else df.filter(F.col("run_id") == run_id)

    def runs(self) -> DataFrame:
        """(run_id, version_id, dataset_id, status, created_at): latest status of every run."""
        return self.read_stage(STATUS_STAGE).groupBy("run_id").agg(
            F.max_by("version_id", "written_at").alias("version_id"),
            F.max_by("dataset_id", "written_at").alias("dataset_id"),
            F.max_by("status", "written_at").alias("status"),
            F.min("written_at").alias("created_at"),
        )

    def run(self, run_id: str) -> DataFrame:
        """The run's row; a run that does not exist is an error."""
        found = self.runs().filter(F.col("run_id") == run_id)
        if found.isEmpty():
            raise LookupError("Analysis run not found")
        return found
