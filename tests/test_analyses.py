"""Statistics of small tables with known answers."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from vouch.operators import correlation, describe, groups
from tests.conftest import rows_of


def test_strong_correlation(people):
    got = correlation.correlations(people, [("Age", "Salary")]).first()
    assert got["correlation"] == pytest.approx(0.988183685359, abs=1e-12)
    assert got["p_value"] == pytest.approx(1.7786420755e-09, rel=1e-9)
    assert (got["sample_size"], got["status"]) == (12, "completed")


def test_pairs_use_complete_rows_only(spark):
    df = spark.createDataFrame(
        [(10, 20), (20, 40), (30, None), (None, 80), (50, 100), (60, 120)], "Revenue int, Cost int")
    got = correlation.correlations(df, [("Revenue", "Cost")]).first()
    assert (got["sample_size"], got["correlation"], got["p_value"]) == (4, pytest.approx(1.0), pytest.approx(0, abs=1e-6))


def test_pairs_without_enough_data_or_variation(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5.0, 1.0), (2.0, 1.0, 5.0, None), (None, 2.0, 5.0, None), (4.0, None, 5.0, None)],
        "a double, b double, c double, d double")
    got = rows_of(correlation.correlations(df, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]), "first", "second")
    assert got["a", "b"]["status"] == "insufficient_data" and got["a", "b"]["sample_size"] == 1
    assert got["a", "c"]["status"] == "insufficient_variation" and got["a", "c"]["correlation"] is None
    assert got["b", "d"]["sample_size"] == 0 and got["b", "d"]["status"] == "insufficient_data"
    assert got["c", "d"]["sample_size"] == 1


def test_outlier(people, spark):
    values = [45000, 47000, 49000, 60000, 62000, 64000, 70000, 72000, 74000, 80000, 82000, 250000]
    df = spark.createDataFrame([(v,) for v in values], "Salary long")
    statistics = describe.describe(df, ["Salary"])
    row = statistics.first()
    assert (row["q1"], row["q3"], row["iqr"], row["lower_bound"], row["upper_bound"]) == (60000, 74000, 14000, 39000, 95000)
    found = describe.outlier_values(df, statistics, ["Salary"])
    assert [(r["value"], r["n"]) for r in found.collect()] == [(250000.0, 1)]
    assert describe.outlier_summary(found).first()["outlier_count"] == 1


def test_column_without_values_fails(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = rows_of(describe.describe(df, ["a", "b"]), "measure")
    assert got["a"]["status"] == "failed" and got["a"]["q1"] is None
    assert got["b"]["status"] == "completed" and got["b"]["std"] == pytest.approx(0.5**0.5)


def _anova(spark, cells):
    df = spark.createDataFrame([(k, float(v)) for k, values in cells for v in values], "g string, y double")
    table = groups.group_statistics(df, ["y"], ["g"])
    return table, groups.anova(table).first()


def test_group_difference(spark):
    cells = [(g, range(low, low + 30, 5)) for g, low in (("North", 100), ("South", 200), ("West", 300))]
    table, got = _anova(spark, cells)
    assert got["statistic"] == pytest.approx(685.7142857)
    assert got["p_value"] == pytest.approx(1.80490020843e-15, rel=1e-9)
    assert (got["groups"], got["sample_size"], got["minimum_group_size"]) == (3, 18, 6)
    ends = groups.extremes(table).first()
    assert (ends["highest_group"], ends["highest_value"]) == ("West", 312.5)
    assert (ends["lowest_group"], ends["lowest_value"]) == ("North", 112.5)


def test_small_groups_and_missing_keys_stop_the_test(spark):
    _, got = _anova(spark, [("a", [1, 2]), ("b", [5, 6])])
    assert (got["status"], got["statistic"], got["minimum_group_size"]) == ("insufficient_data", None, 2)
    table, got = _anova(spark, [("a", [1, 2, 3]), (None, [5, 6, 7, 8])])
    assert (got["status"], got["minimum_group_size"], got["smallest_count"], got["groups"]) == ("insufficient_data", 0, 3, 2)
    assert rows_of(table, "key")[None]["count"] == 4


def test_constant_groups(spark):
    _, got = _anova(spark, [("a", [10] * 100), ("b", [100] * 100), ("c", [1000] * 100)])
    assert (got["statistic"], got["p_value"], got["p_value_underflow"]) == (float("inf"), 0.0, True)
    _, got = _anova(spark, [("a", [3] * 4), ("b", [3] * 4)])
    assert got["statistic"] is None and got["p_value"] is None


def test_two_groups_equal_the_t_test(spark):
    """With two groups the p-value is that of the correlation with the group number."""
    a, b = [3.1, 4.7, 5.0, 6.2, 4.4], [5.5, 7.1, 6.0, 8.3]
    _, got = _anova(spark, [("a", a), ("b", b)])
    df = spark.createDataFrame([(0.0, v) for v in a] + [(1.0, v) for v in b], "g double, y double")
    assert got["p_value"] == pytest.approx(correlation.correlations(df, [("g", "y")]).first()["p_value"], rel=1e-9)


def test_bar_chart_keeps_both_ends(spark):
    cells = [(f"g{i:02d}", [i, i, i]) for i in range(20)]
    table, _ = _anova(spark, cells)
    rows = groups.bar_groups(table).orderBy("bar").collect()
    assert [r["label"] for r in rows] == [f"g{i:02d}" for i in (19, 18, 17, 16, 15, 14, 5, 4, 3, 2, 1, 0)]
    assert (rows[0]["total_groups"], rows[0]["displayed_groups"], rows[0]["sampled"]) == (20, 12, True)
    table, _ = _anova(spark, [("x", [1, 2]), (None, [3, 4])])
    assert [r["label"] for r in groups.bar_groups(table).orderBy("bar").collect()] == ["Missing", "x"]


def test_wide_correlations_match_the_pairwise_form(spark, monkeypatch):
    """Missing cells, a constant column, one constant where the other is present, values far from zero, few rows."""
    rng = random.Random(14)
    rows = [tuple([None if rng.random() < 0.2 else rng.gauss(0, 1), 1e9 + rng.random() + i, 5.0, None if i % 2 else 7.0, 1.0 if i % 2 else float(i),
                   rng.random() if i < 1 else None, None]) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).repartition(3)
    pairs = list(combinations(df.columns, 2))
    found = []
    for wide in (1, 10**9):
        monkeypatch.setattr(correlation, "WIDE", wide)
        found.append({(r["first"], r["second"]): r for r in correlation.correlations(df, pairs).collect()})
    assert found[0].keys() == found[1].keys() == set(pairs)
    for pair in pairs:
        one, two = found[0][pair], found[1][pair]
        assert (one["sample_size"], one["status"], one["reason"]) == (two["sample_size"], two["status"], two["reason"]), pair
        for name in ("correlation", "p_value"):
            assert one[name] == two[name] or one[name] == pytest.approx(two[name], rel=1e-6, abs=1e-9), (pair, name)
