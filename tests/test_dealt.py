"""Tables of runs written in buckets: no shuffle, the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vouch.operators import describe, explain, insights, series, verify
from vouch.operators.quantiles import null_safe
from vouch.session import DEAL, materialise, release_intermediates, tasks_for, with_deal

BY = [DEAL, "run"]


def _rows(spark):
    """Runs with a null key, equal rows, equal dates, ties of the peak, missing and constant values."""
    day = datetime(2020, 1, 1)
    rows = [(run, day + timedelta(days=(i * 7) % 5), i // 2, float((i * 3) % 4), None if i % 5 == 0 and run == 1 else float(i % 3), 2.0)
            for run, n in ((1, 9), (2, 2), (3, 1), (None, 7), (5, 12)) for i in range(n)]
    return with_deal(spark.createDataFrame(rows + rows[:4], "run long, at timestamp, o int, v double, g double, k double"), ["run"])


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sorted(df):
    return sorted(map(str, df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()))


def test_joined_where_they_lie(spark):
    df = materialise(_rows(spark).repartition(4, DEAL), "dealt", "zstd", 4)
    totals = materialise(df.groupBy(*BY).agg(F.sum("v").alias("total")), "totals", "zstd", 4)
    with tasks_for(spark, 1):
        joined = null_safe(df.withColumn("n", F.lit(1)), totals.hint("merge"), BY, "left")
        assert "Exchange" not in _plan(joined)
    assert joined.count() == 35 and joined.filter("run is null and total is not null").count() == 7
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    name = df._jdf.queryExecution().optimizedPlan().toString()
    assert release_intermediates(spark) >= 2 and "vouch_" in name and not [t for t in spark.catalog.listTables() if t.name.startswith("vouch_")]


def test_dealt_results_are_the_same(spark):
    raw = _rows(spark)
    df = materialise(raw.repartition(4, DEAL), "dealt", "zstd", 4)
    measures = ["v", "g", "k"]

    def trend(rows, names, **options):
        return series.trends(series.series_moments(rows, names, "at", ["o", "v"], BY, **options), "at", BY)

    for names in (["v", "g"], measures):  # with k, values are taken relative to their range
        assert _sorted(trend(df, names, most=12, dealt=True)) == _sorted(trend(raw, names))
        with tasks_for(spark, 1):
            whole = [m for m in names if m != "g"]
            assert "hashpartitioning" not in _plan(series.series_moments(df, whole, "at", ["o", "v"], BY, most=12, dealt=True))
            assert "hashpartitioning" not in _plan(describe.describe(df, names, BY, most=12))
    known = describe.describe(df, measures, BY, most=12)
    assert _sorted(known) == _sorted(describe.describe(raw, measures, BY, direct_cells=1_000_000))


def test_texts_are_not_broadcast(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "outlier", "t", ["v"], "m", 3)], "run long, rank int, insight_type string, title string, source_columns array<string>, method string, n long")
    ranked = ranked.withColumns({
        "evidence": insights.record(insights.EVIDENCE, {"outlier_count": "n"}), "limitations": F.array(F.lit("l")),
        "verification": insights.record(verify.VERIFICATION, {"status": "'verified'"})})
    assert "BroadcastHashJoin" not in _plan(explain.explain_ranked(ranked, by=["run"]))
