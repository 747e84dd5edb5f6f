"""The whole run: validate, protect, profile, plan, analyse, verify, rank, explain, recommend."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import (
    AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException,
    SparkRuntimeException,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.operators import (
    correlation,
    describe,
    explain,
    groups,
    insights,
    privacy,
    profile,
    ranking,
    report,
    roles,
    series,
    verify,
)
from vouch.plans import planner
from vouch.session import materialise
from vouch.sources.runs import RunStore, run_status
from vouch.sources.tables import normalise, safe_projection

# What an analysis may fail with because of its data.
DATA_ERRORS = (
    AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException,
    SparkRuntimeException,
)


@dataclass
class Run:
    """Outcome of one run; every table carries ``run_id``."""

    run_id: str
    status: str
    validation: DataFrame
    protected: DataFrame | None = None
    catalogue: DataFrame | None = None
    plan: DataFrame | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)
    outcomes: DataFrame | None = None
    insights: DataFrame | None = None
    ranked: DataFrame | None = None

    def report(self) -> DataFrame:
        """The 16 report columns of the ranked insights; no rows for a run without any."""
        if self.ranked is None:
            return report.ranked_rows(report.empty_ranked(self.validation.sparkSession), ["run_id"])
        return report.ranked_rows(self.ranked, ["run_id"])


def _planned(plan: DataFrame) -> dict[str, list[tuple]]:
    """Plan rows by type.  The plan has one row per analysis of one table's columns."""
    out: dict[str, list[tuple]] = {}
    for row in plan.orderBy("ord").collect():
        cells = tuple(row[c] for c in ("measure", "dimension", "date", "first", "second") if row[c] is not None)
        out.setdefault(row["type"], []).append(cells)
    return out


def _unique(cells: Sequence[tuple], place: int) -> list[str]:
    return list(dict.fromkeys(c[place] for c in cells))


def analyse(
    df: DataFrame,
    *,
    run_id: str | None = None,
    dataset_id: str | None = None,
    version_id: str | None = None,
    order_by: Sequence[str] | None = None,
    unique: bool = False,
    candidates: DataFrame | None = None,
    explain_limit: int = fixed.EXPLAIN_LIMIT,
    top: int = fixed.TOP_INSIGHTS,
    store: RunStore | None = None,
) -> Run:
    """Run every stage over ``df``.

    ``order_by`` fixes the order of rows within one date; ``unique`` promises that
    it identifies a row.  ``candidates`` are proposed explanations (run_id,
    insight_type, source_columns, text).  All analyses of one type run as one job; an
    analysis that its data makes fail is recorded as failed and the others go on.  Errors
    of storage or of the cluster end the run.
    """
    run_id = run_id or str(uuid.uuid4())
    version_id = version_id or run_id

    def tagged(table: DataFrame) -> DataFrame:
        return table.withColumn("run_id", F.lit(run_id))

    def keep(stage: str, table: DataFrame) -> DataFrame:
        """Compute a stage once, into the run store when there is one."""
        if store is None:
            return materialise(table, stage)
        store.write_stage(stage, table)
        return store.read_stage(stage, run_id, table.schema)

    def finish(status: str) -> None:
        if store is not None:
            store.set_status(run_id, version_id, dataset_id, status)

    finish("running")
    try:
        df = normalise(df) if len(set(df.columns)) == len(df.columns) else df
        validation = keep("validation", tagged(profile.validation_summary(df)))
        verdict = validation.first()
        if not verdict["valid"]:
            finish("failed")
            return Run(run_id, "failed", validation)
        rows = verdict["row_count"]

        counted = profile.column_counts(df)
        protected = keep("protected", tagged(privacy.detect(df, counted)))
        hidden = [r["column"] for r in protected.select("column").collect()]
        safe = safe_projection(df, hidden)
        catalogue = keep("catalogue", tagged(roles.with_roles(profile.profile_columns(safe))))
        plan = keep("plan", tagged(planner.build_plan(catalogue)))
        planned = _planned(plan)

        results: dict[str, DataFrame] = {}
        checks: dict[str, DataFrame] = {}
        outcomes = []
        by = ["run_id"]

        def attempt(kind: str, columns: Sequence[str], job: Callable[[list[tuple]], dict[str, DataFrame]]) -> None:
            """Run the job of one analysis type and record the status of each analysis.

            All analyses of a type are one job.  If it fails for a reason that lies in
            the data, each analysis is tried alone and the sound ones run together.
            """
            if kind not in planned:
                return
            part = plan.filter(F.col("type") == kind)
            shape = [*columns, "run_id"]
            errors: dict[tuple, str] = {}
            made: dict[str, DataFrame] = {}
            try:
                made = job(planned[kind])
            except DATA_ERRORS:
                for cell in planned[kind]:
                    try:
                        job([cell])
                    except DATA_ERRORS as problem:
                        errors[cell] = str(problem)
                sound = [cell for cell in planned[kind] if cell not in errors]
                made = job(sound) if sound else {}
            for stage, table in made.items():
                results[stage] = table if store is None else keep(stage, table)
            # one literal per failed analysis of one table's plan
            failure = F.lit(None).cast("string")
            for cell, text in errors.items():
                failure = F.when(F.struct(*columns) == F.struct(*map(F.lit, cell)), F.lit(text)).otherwise(failure)
            part = part.drop("status").withColumn("_error", failure)
            if kind in results:
                done = results[kind].select(*shape, F.when(
                    F.col("status") == "failed", F.lit("failed")).otherwise(F.lit("completed")).alias("status"))
                part = part.join(done, shape, "left")
                part = part.withColumn("status", F.when(F.col("_error").isNotNull(), F.lit("failed")).otherwise(F.col("status")))
            else:
                part = part.withColumn("status", F.lit("failed"))
            error = F.coalesce("_error", F.when(F.col("status") == "failed", F.lit("no values")))
            outcomes.append(part.select(
                "run_id", "type", "measure", "dimension", "date", "first", "second", "status",
                error.cast("string").alias("error")))

        def held(stage: str, table: DataFrame) -> DataFrame:
            """A result of a job that may still fail; the run store gets it afterwards."""
            return materialise(tagged(table), stage)

        def run_describe(cells: list[tuple]) -> dict[str, DataFrame]:
            names = _unique(cells, 0)
            statistics = held("descriptive_statistics", describe.describe(safe, names, rows=rows))
            values = held("outlier_values", describe.outlier_values(safe, statistics.drop("run_id"), names))
            recount = held("outlier_recount", describe.outlier_recount(safe, statistics.drop("run_id"), names))
            checks["outliers"] = insights.outlier_result(statistics, recount, by)
            return {"descriptive_statistics": statistics, "outlier_values": values}

        def run_groups(cells: list[tuple]) -> dict[str, DataFrame]:
            names, dimensions = _unique(cells, 0), _unique(cells, 1)
            table = held("groups", groups.group_statistics(safe, names, dimensions, rows=rows))

            def compared(found: DataFrame) -> DataFrame:
                return insights.group_result(groups.extremes(found, by), groups.anova(found, by), by)

            # the check takes its groups from the rows, not from the table of the claim
            again = materialise(tagged(groups.recounted(safe, table.drop("run_id"), names, dimensions)), "groups-again")
            checks["groups"] = compared(again)
            return {"groups": table, "group_comparison": materialise(compared(table), "group_comparison")}

        def run_series(cells: list[tuple]) -> dict[str, DataFrame]:
            found, again = [], []
            for date in _unique(cells, 1):
                moments = materialise(series.series_moments(safe, _unique(cells, 0), date, order_by, exact=True), "series-moments")
                found.append(series.trends(moments, date))
                again.append(series.trends(moments, date, exact=True))
            checks["trends"] = tagged(reduce(DataFrame.unionByName, again))
            return {"time_series": held("time_series", reduce(DataFrame.unionByName, found))}

        def run_correlations(cells: list[tuple]) -> dict[str, DataFrame]:
            checks["correlations"] = tagged(correlation.recomputed(safe, cells))
            return {"correlation": held("correlation", correlation.correlations(safe, cells))}

        attempt("descriptive_statistics", ["measure"], run_describe)
        attempt("group_comparison", ["measure", "dimension"], run_groups)
        attempt("time_series", ["measure", "date"], run_series)
        attempt("correlation", ["first", "second"], run_correlations)
        if "descriptive_statistics" in results:
            results["outliers"] = insights.outlier_result(
                results["descriptive_statistics"], describe.outlier_summary(results["outlier_values"], by), by)

        if not outcomes:
            finish("completed")
            return Run(run_id, "completed", validation, protected, catalogue, plan)
        outcome = outcomes[0]
        for part in outcomes[1:]:
            outcome = outcome.unionByName(part)
        outcome = keep("outcomes", outcome)
        status = run_status(outcome, by).first()["status"]

        given = {
            "groups": results.get("group_comparison"), "correlations": results.get("correlation"),
            "trends": results.get("time_series"), "outliers": results.get("outliers"),
        }
        if all(table is None for table in given.values()):
            finish(status)
            return Run(run_id, status, validation, protected, catalogue, plan, results, outcome)
        found = insights.discover(**given, plan=plan, by=by, plan_by=by)
        # claims are compared with a second computation, not with the tables they were made from
        again = {k: checks[k] for k, table in given.items() if table is not None}
        checked = verify.verify(found, verify.actuals(**again, by=by), by)
        scored = ranking.with_score(ranking.with_confidence(checked))
        lineage = F.struct(
            F.lit(dataset_id).cast("string").alias("dataset_id"), F.lit(version_id).alias("version_id"),
            F.lit(run_id).alias("run_id"))
        scored = keep("insights", scored.withColumn("lineage", lineage))
        best = ranking.select_top(scored, by, top)
        explained = explain.explain_ranked(
            best, candidates, explain_limit, by, results.get("outlier_values"), results.get("groups"))
        ranked = keep("ranked", explain.recommend(explained))
        finish(status)
        return Run(run_id, status, validation, protected, catalogue, plan, results, outcome, scored, ranked)
    except Exception:
        finish("failed")
        raise
