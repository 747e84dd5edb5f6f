"""Insight layer: verification under tampering, confidence, score, guardrail, reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vouch.operators import correlation, describe, explain, groups, insights, ranking, report, series, verify
from vouch.session import materialise
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def results(spark):
    """One result of each type over a small table."""
    rows = [
        (f"2026-01-{i + 1:02d}", "North" if i < 6 else "South", 100.0 + 20 * i, 50.0 + 11 * i, 5.0 if i != 7 else 900.0)
        for i in range(12)
    ]
    df = spark.createDataFrame(rows, "day string, region string, revenue double, cost double, fee double")
    table = groups.group_statistics(df, ["revenue"], ["region"])
    statistics = materialise(describe.describe(df, ["fee"]), "s")
    values = describe.outlier_values(df, statistics, ["fee"])
    return {
        "groups": materialise(insights.group_result(groups.extremes(table), groups.anova(table)), "g"),
        "correlations": materialise(correlation.correlations(df, [("revenue", "cost")]), "c"),
        "trends": materialise(series.trend_metrics(series.series_points(df, ["revenue"], "day"), "day"), "t"),
        "outliers": materialise(insights.outlier_result(statistics, describe.outlier_summary(values)), "o"),
    }


@pytest.fixture(scope="module")
def scored(results):
    checked = verify.verify(insights.discover(**results), verify.actuals(**results))
    return materialise(ranking.with_score(ranking.with_confidence(checked)), "scored")


def test_discovery_titles(scored):
    titles = {r["insight_type"]: r["title"] for r in scored.collect()}
    assert titles == {
        "group_difference": "South has the highest average revenue",
        "correlation": "revenue and cost have a strong positive relationship",
        "time_series_trend": "revenue shows a rising trend over day",
        "outlier": "Potential outliers detected in fee",
    }


def test_confidence_and_score(scored):
    got = rows_of(scored, "insight_type")
    assert {r["verification"]["status"] for r in got.values()} == {"verified"}
    corr = got["correlation"]
    assert corr["confidence"]["score"] == pytest.approx(0.30 + 0.30 + 0.20 * 0.6 + 0.20)
    assert corr["score"] == pytest.approx(0.45 + 0.20 + 0.25 * corr["confidence"]["score"] + 0.05)
    outlier = got["outlier"]
    assert (outlier["confidence"]["score"], outlier["confidence"]["level"], outlier["score"]) == (1.0, "high", 0.815)
    trend = got["time_series_trend"]
    assert trend["confidence"]["score"] == pytest.approx(0.30 + 0.30 + 0.20 * 0.6 + 0.20)
    assert trend["score"] == pytest.approx(0.4 + 0.2 + 0.15 + 0.2 * trend["confidence"]["score"] + 0.025)


TAMPERED = [
    ("correlation", "correlation"), ("correlation", "p_value"), ("correlation", "sample_size"),
    *[("group_difference", f) for f in (
        "highest_group", "lowest_group", "highest_value", "lowest_value", "absolute_difference",
        "percentage_difference", "statistical_test", "statistic", "p_value")],
    *[("time_series_trend", f) for f in insights.TREND_FIELDS],
]


def test_every_false_claim_is_named(results):
    """All tampered claims are verified in one go, each in its own run."""
    found = insights.discover(**results)
    parts = []
    for index, (kind, field) in enumerate(TAMPERED):
        numeric = insights.EVIDENCE[field] != "string"
        claim = F.col(f"evidence.{field}")
        wrong = (claim + 1).cast(insights.EVIDENCE[field]) if numeric else F.lit("nowhere")
        parts.append(found.filter(F.col("insight_type") == kind).withColumn(
            "evidence", F.col("evidence").withField(field, wrong)).withColumn("case", F.lit(index)))
    tampered = parts[0]
    for part in parts[1:]:
        tampered = tampered.unionByName(part)
    out = verify.verify(tampered, verify.actuals(**results)).select("case", "verification").collect()
    assert len(out) == len(TAMPERED)
    for row in out:
        assert row["verification"]["status"] == "failed", TAMPERED[row["case"]]
        assert [m["field"] for m in row["verification"]["mismatches"]] == [TAMPERED[row["case"]][1]]


def test_other_verdicts(spark, results):
    found = insights.discover(**results)
    one = lambda kind, df=found: df.filter(F.col("insight_type") == kind)
    actual = verify.actuals(**results)
    blank = one("correlation").withColumn("evidence", F.col("evidence").withField("p_value", F.lit(None).cast("double")))
    assert verify.verify(blank, actual).first()["verification"]["reason"] == "P-value is missing."
    # A group claim may leave the p-value out.
    blank = one("group_difference").withColumn("evidence", F.col("evidence").withField("p_value", F.lit(None).cast("double")))
    assert verify.verify(blank, actual).first()["verification"]["status"] == "verified"
    few = verify.actuals(correlations=results["correlations"].withColumn("sample_size", F.lit(2).cast("long")))
    assert verify.verify(one("correlation"), few).first()["verification"]["status"] == "insufficient_data"
    digest = one("outlier").withColumn("calculation", F.col("calculation").withField("outlier_digest", F.lit("1")))
    assert verify.verify(digest, actual).first()["verification"]["status"] == "failed"
    lone = found.withColumn("source_columns", F.array(F.lit("elsewhere")))
    reasons = {r["verification"]["reason"] for r in verify.verify(lone, actual).collect()}
    assert reasons == {"No matching analysis result found.", "No matching descriptive statistics result found."}
    weak = verify.actuals(groups=results["groups"].withColumn("smallest_count", F.lit(2).cast("long")))
    assert verify.verify(one("group_difference"), weak).first()["verification"]["status"] == "insufficient_data"


def test_selection_keeps_first_and_ranks(scored):
    again = scored.withColumns({"ord": F.concat(F.lit("z"), "ord"), "title": F.lit("again")})
    failed = scored.withColumn("verification", F.col("verification").withField("status", F.lit("failed")))
    best = ranking.select_top(scored.unionByName(again).unionByName(failed), limit=3).orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2, 3]
    assert "again" not in {r["title"] for r in best}
    assert [r["score"] for r in best] == sorted((r["score"] for r in scored.collect()), reverse=True)[:3]


def test_local_explanations(scored):
    got = rows_of(explain.explain_local(scored), "insight_type")
    assert got["outlier"]["explanation"] == (
        "fee contains 1 verified IQR outlier observations. The verified IQR bounds are 5.0 to 5.0. An outlier is not "
        "automatically a data error and should be reviewed in business context. Limitation: An outlier is not "
        "necessarily an error.")
    assert "moves from 100.0 on 2026-01-01 to 320.0 on 2026-01-12." in got["time_series_trend"]["explanation"]
    assert {r["status"] for r in got.values()} == {"approved"}


def test_guardrail(spark, scored):
    offers = {
        "correlation": "Based on 12 observations.", "outlier": "A value of 900 stands out.",
        "time_series_trend": "It rose by 221 from 100.", "group_difference": "   ",
    }
    offered = scored.select("insight_type", "source_columns").join(
        spark.createDataFrame(list(offers.items()), "insight_type string, text string"), "insight_type")
    got = rows_of(explain.check_candidates(scored, offered), "insight_type")
    assert got["correlation"]["status"] == "approved"
    assert got["time_series_trend"]["unsupported_numbers"] == [221.0]
    assert (got["group_difference"]["status"], got["group_difference"]["reason"]) == ("rejected", "invalid_response")
    assert got["outlier"]["unsupported_numbers"] == [900.0]
    # The listed outliers are evidence too.
    values = spark.createDataFrame([("fee", 900.0)], "measure string, value double")
    got = rows_of(explain.check_candidates(scored, offered, outlier_values=values), "insight_type")
    assert got["outlier"]["status"] == "approved"
    refused = scored.withColumn("verification", F.col("verification").withField("status", F.lit("not_significant")))
    assert {r["reason"] for r in explain.check_candidates(refused, offered).collect()} == {"insight_not_verified"}
    nothing = rows_of(explain.check_candidates(scored, offered.limit(0)), "insight_type")
    assert nothing["outlier"]["status"] == "unavailable"


def test_digit_in_a_column_name_is_unsupported(scored):
    renamed = scored.withColumn("source_columns", F.transform("source_columns", lambda c: F.concat(F.lit("Q7"), c)))
    got = rows_of(explain.explain_local(renamed), "insight_type")
    assert got["correlation"]["status"] == "rejected" and got["correlation"]["unsupported_numbers"] == [7.0, 7.0]


def test_candidates_up_to_the_limit(spark, scored):
    best = ranking.select_top(scored)
    offered = best.select("insight_type", "source_columns", F.lit("Worth a look.").alias("text"))
    sources = [r["explanation"]["source"] for r in explain.explain_ranked(best, offered, 2).orderBy("rank").collect()]
    assert sources == ["llm", "llm", "deterministic", "deterministic"]
    sources = [r["explanation"]["source"] for r in explain.explain_ranked(best, offered, -4).orderBy("rank").collect()]
    assert set(sources) == {"deterministic"}


def test_report_rows_and_summary(scored):
    done = materialise(explain.recommend(explain.explain_ranked(ranking.select_top(scored))), "done")
    rows = report.report_rows(done, done, done).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
    assert rows[0]["recommendation_priority"] == "medium" and rows[0]["explanation_status"] == "approved"
    summary = report.run_summary(done).first()
    assert summary["verified_signals"] == 4 and summary["top_title"] == rows[0]["title"]
    fields = {r["field"] for r in report.evidence_rows(done).filter(F.col("title").startswith("Potential")).collect()}
    assert fields == {"outlier_count", "lower_bound", "upper_bound"}
    cells = report.report_cells(report.report_rows(done, done, done)).first()
    assert cells["evidence"].startswith("{") and isinstance(cells["rank"], int)


def test_run_comparison(scored):
    best = materialise(ranking.select_top(scored), "best")
    later = best.filter(F.col("insight_type") != "outlier").withColumn(
        "score", F.when(F.col("insight_type") == "correlation", F.col("score") + 0.01).otherwise(F.col("score")))
    got = report.compare_runs(best, later).collect()
    assert {(r["change"], r["key"].split("::")[0]) for r in got} == {("removed", "outlier"), ("changed", "correlation")}
    assert [round(r["score_delta"], 6) for r in got if r["change"] == "changed"] == [0.01]
    assert {r["change"] for r in report.compare_runs(later, best).collect()} == {"added", "changed"}


def test_group_sizes_may_be_stated(spark, people):
    """Sizes of 20 and 12: both may be named, another number may not."""
    from vouch.plans.pipeline import analyse

    rows = [("North", 100.0 + i % 5) for i in range(20)] + [("South", 300.0 + i % 5) for i in range(12)]
    df = spark.createDataFrame(rows, "Region string, Revenue double")
    for text, status in (("North has 20 rows and South 12.", "llm"), ("North has 21 rows.", "deterministic")):
        texts = spark.createDataFrame([("r", "group_difference", ["Revenue", "Region"], text)] * 2, "run_id string, insight_type string, source_columns array<string>, text string")
        ranked = analyse(df, run_id="r", candidates=texts).ranked.filter("insight_type = 'group_difference'").collect()
        assert len(ranked) == 1 and ranked[0]["explanation"]["source"] == status
