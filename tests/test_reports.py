"""Reports of many runs, and steps that must not depend on the number of runs."""

from __future__ import annotations

import math
import os

from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.functions.special import with_beta_tail
from vouch.operators import describe, ranking, series
from vouch.sources import reports


def test_reports_of_many_runs_share_files(spark, tmp_path):
    """A report is a whole CSV text, but not a folder, a file and a rename of its own."""
    awkward = F.element_at(F.array(*[F.lit(v) for v in ('a, "b"', "two\nlines", " outer ", '""', "plain", 'x"y')]), (F.col("id") % 6 + 1).cast("int"))
    cells = spark.range(600).select(
        F.concat(F.lit("run "), (F.col("id") % 200).cast("string")).alias("run_id"),
        *[(F.floor(F.col("id") / 200) + 1).cast("int").alias(c) if c == "rank" else awkward.alias(c) for c in fixed.REPORT_COLUMNS])
    path = str(tmp_path / "reports")
    reports.write_reports(cells, path)
    assert sum(len(files) for _, _, files in os.walk(path)) < 50
    whole = spark.read.parquet(path).filter("run_id = 'run 7'").first()["report"]
    assert whole.startswith("﻿" + ",".join(fixed.REPORT_COLUMNS) + "\n")
    given = sorted(tuple(map(str, r)) for r in cells.collect())
    assert sorted(tuple(r) for r in reports.read_reports(spark, path).select(*cells.columns).collect()) == given


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_runs_are_dealt_by_run(spark):
    """Trends of small runs need one shuffle by run, no range sort and no expanded rows; the figures are those of the range sort."""
    lines = spark.range(900).selectExpr("id % 30 as run", "id as at", "cast(id * 7919 % 101 as double) as a", "cast(id % 13 as double) as b")
    moments = series.series_moments(lines, ["a", "b"], "at", ["at"], ["run"])
    assert "rangepartitioning" not in plan_of(moments)
    assert moments.count() == 60
    near = sorted(map(str, series.trends(moments, "at", ["run"]).collect()))
    one = series.trends(series.series_moments(lines.filter("run = 4"), ["a", "b"], "at", ["at"]), "at")
    found = {r["measure"]: r for r in one.collect()}
    for row in series.trends(moments, "at", ["run"]).filter("run = 4").collect():
        for field in found["a"].asDict():
            have, want = row[field], found[row["measure"]][field]
            assert have == want or math.isclose(have, want, rel_tol=1e-9), field
    assert len(near) == 60


def test_outliers_of_runs_join_rows_once(spark):
    rows = spark.createDataFrame([(None if k % 2 else 1, float(v), 1.0) for k in range(2) for v in [1, 2, 3, 4, 99, 99]], "run long, x double, y double")
    statistics = describe.describe(rows, ["x", "y"], ["run"])
    values = describe.outlier_values(rows, statistics, ["x", "y"], ["run"])
    bounds = {(r["run"], r["measure"]): r for r in statistics.collect()}
    want = {(run, 99.0, 2) for run in (None, 1) if bounds[run, "x"]["upper_bound"] < 99}
    assert {(r["run"], r["value"], r["n"]) for r in values.collect()} == want


def test_top_insights_are_dealt_once(spark):
    row = spark.range(40).select(
        (F.col("id") % 4).alias("run"), F.lit("outlier").alias("insight_type"), F.array(F.col("id").cast("string")).alias("source_columns"),
        F.lit("t").alias("title"), F.col("id").alias("ord"), F.rand(1).alias("score"), F.struct(F.lit("verified").alias("status")).alias("verification"))
    best = ranking.select_top(row, ["run"])
    assert best.count() == 40 and plan_of(best).count("Exchange hashpartitioning") == 1


def test_beta_tail_known_values(spark):
    rows = spark.createDataFrame([(2.0, 3.0, 0.5), (0.5, 0.5, 0.25), (1e6, 0.5, 0.999999), (14.0, 0.5, 0.9), (None, 1.0, 0.5), (5.0, 1.0, 0.0)], "a double, b double, x double")
    got = [r["p"] for r in with_beta_tail(rows, "p", "a", "b", "x", "1D - x").collect()]
    assert math.isclose(got[0], 0.6875, rel_tol=1e-12) and math.isclose(got[1], 1 / 3, rel_tol=1e-12)
    # p of chi-square 2 with one degree of freedom, nearly
    assert math.isclose(got[2], math.erfc(1.0), rel_tol=1e-5)
    assert got[4] is None and got[5] == 0.0
