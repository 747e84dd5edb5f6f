"""Quantiles and positions against brute force, in their small and large forms."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from vouch.functions.numbers import order_key
from vouch.operators import ordering, quantiles, series
from tests.conftest import rows_of


def nearest(values, q):
    ordered = sorted(values)
    return ordered[math.floor((len(ordered) - 1) * q + 0.5)]


def middle(values):
    ordered = sorted(values)
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


@pytest.fixture(scope="module")
def mixed(spark):
    """Groups of very different shape; one value and one group hold most rows."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else rng.choice(["a", "b", None])
        skewed = 7.0 if rng.random() < 0.4 else math.exp(rng.gauss(0, 4))
        rows.append((group, skewed, float(rng.randrange(5)), None if rng.random() < 0.2 else rng.uniform(-1, 1)))
    rows.append(("one", 1.0, 2.0, 3.0))
    rows.append(("empty", 1.0, 2.0, None))
    return rows, spark.createDataFrame(rows, "g string, x double, y double, z double")


@pytest.mark.parametrize("options", [{}, {"direct_cells": 0}, {"direct_cells": 0, "group_rows": 300}, {"direct_cells": 0, "group_rows": 0}, {"direct_cells": 0, "group_rows": 20, "fineness": 1, "rounds": (56, 50, 21, 0)}])
def test_order_statistics(mixed, options):
    rows, df = mixed
    found = rows_of(quantiles.order_statistics(df, ["x", "y", "z"], ["g"], **options), "g", "measure")
    seen = 0
    for group in {r[0] for r in rows}:
        for place, name in ((1, "x"), (2, "y"), (3, "z")):
            values = [r[place] for r in rows if r[0] == group and r[place] is not None]
            if not values:
                assert (group, name) not in found
                continue
            got = found[group, name]
            want = (len(values), nearest(values, 0.25), middle(values), nearest(values, 0.75))
            assert (got["n"], got["q1"], got["median"], got["q3"]) == want
            seen += 1
    assert seen == len(found)


def test_order_keys_follow_the_numbers(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, math.nextafter(1.0, 0), math.nextafter(2.0, 0), 8.0, math.nextafter(8.0, 9)]
    values += [math.ldexp(rng.random(), rng.randint(-1074, 1020)) for _ in range(500)] + [2.0 ** k for k in range(-1070, 1020, 37)]
    values += [math.nextafter(v, math.inf) for v in values[:200]]
    values += [-v for v in values] + [math.inf]
    values.sort()
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k"))
    got = sorted((r["v"], r["k"]) for r in df.collect())
    assert all((a < c) == (b < d) and (a == c) == (b == d) for (a, b), (c, d) in zip(got, got[1:]))
    assert all(k == struct.unpack(">q", struct.pack(">d", v))[0] for v, k in got if v > 0)


def test_medians_agree_in_both_forms(mixed):
    _, df = mixed
    small = {(r["g"], r["measure"]): r["median"] for r in quantiles.medians(df, ["x", "z"], ["g"]).collect()}
    large = {(r["g"], r["measure"]): r["median"] for r in quantiles.medians(df, ["x", "z"], ["g"], direct_cells=0).collect()}
    assert {k: v for k, v in small.items() if v is not None} == large


@pytest.mark.parametrize("direct_rows", [10**6, 0])
def test_positions_count_each_mark_apart(spark, direct_rows):
    rng = random.Random(9)
    # A third of the rows are one and the same row.
    rows = [("k", 5, 1.0)] * 400 + [
        (rng.choice(["k", "m"]), rng.randrange(20), None if rng.random() < 0.3 else rng.random()) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, d int, y double").repartition(7)
    placed = ordering.positions(
        df, [F.col("d")], {"d": F.col("d"), "y": F.col("y")},
        {"y": (F.col("y").isNotNull(), F.col("y")), "all": (F.lit(True), None)}, ["g"], direct_rows=direct_rows)
    out = placed.collect()
    for group in ("k", "m"):
        ordered = sorted([r[1:] for r in rows if r[0] == group], key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        present = [r for r in ordered if r[1] is not None]
        covered = [None] * len(present)
        covered_all = 0
        for row in out:
            if row["g"] != group:
                continue
            covered_all += row["copies"]
            assert row["n_all"] == len(ordered) and row["n_y"] == len(present)
            if row["y"] is None:
                assert row["pos_y"] is None
                continue
            assert row["mean_y"] == pytest.approx(sum(r[1] for r in present) / len(present))
            for i in range(row["pos_y"], row["pos_y"] + row["copies"]):
                assert covered[i] is None
                covered[i] = (row["d"], row["y"])
        assert covered == present
        assert covered_all == len(ordered)


@pytest.mark.parametrize("direct_rows", [10**6, 0])
@pytest.mark.parametrize("n", [3, 200, 401, 1000])
def test_scatter_sample(spark, n, direct_rows):
    df = spark.range(n).select(F.col("id").alias("Age"), (F.col("id") * 1000).alias("Salary"))
    out = ordering.scatter_sample(df, [("Age", "Salary")], ["Age"], unique=True, direct_rows=direct_rows)
    got = [row["x"] for row in out.orderBy("sample_index").collect()]
    want = list(range(n)) if n <= 200 else [round(i * (n - 1) / 199) for i in range(200)]
    assert got == want
    assert out.first()["sampled"] == (n > 200)


def test_sample_finds_positions_inside_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, 700, 1000), (2, 700, 300, 1000)], "v int, pos long, copies long, n long")
    out = ordering.sample_positions(df, 240, half_even=False).groupBy("v").count().collect()
    want = [math.floor(i * 999 / 239 + 0.5) for i in range(240)]
    assert {r["v"]: r["count"] for r in out} == {1: sum(p < 700 for p in want), 2: sum(p >= 700 for p in want)}


def trend_by_hand(values):
    n = len(values)
    mx, my = (n - 1) / 2, sum(values) / n
    sxy = sum((i - mx) * (v - my) for i, v in enumerate(values))
    sxx = sum((i - mx) ** 2 for i in range(n))
    syy = sum((v - my) ** 2 for v in values)
    return sxy / sxx, (sxy * sxy / (sxx * syy) if syy else 1.0)


@pytest.mark.parametrize("direct_rows", [10**6, 0])
def test_trend_over_repeated_points(spark, direct_rows):
    """Folded copies give the same trend as the rows they stand for."""
    rng = random.Random(3)
    rows = [(f"2026-01-{d:02d}", float(v)) for d, v in ((rng.randrange(1, 9), rng.randrange(4)) for _ in range(300))]
    df = spark.createDataFrame(rows, "day string, y double")
    points = series.series_points(df, ["y"], "day", ["y"], direct_rows=direct_rows)
    got = series.trend_metrics(points, "day").first()
    values = [v for _, v in sorted(rows)]
    slope, r2 = trend_by_hand(values)
    assert got["slope_per_observation"] == pytest.approx(slope)
    assert got["r_squared"] == pytest.approx(r2)
    assert got["latest_moving_average"] == pytest.approx(sum(values[-3:]) / 3)
    assert (got["first_value"], got["last_value"]) == (values[0], values[-1])
    assert got["latest_period_change"] == values[-1] - values[-2]


def test_small_series(spark):
    df = spark.createDataFrame(
        [("2026-01-03", 300), ("2026-01-01", 100), ("2026-01-05", None), ("2026-01-02", 200), ("2026-01-04", 400)],
        "Date string, Revenue long")
    points = series.series_points(df, ["Revenue"], "Date")
    assert [(r["pos"], r["date"], r["value"]) for r in points.orderBy("pos").collect()] == [
        (0, "2026-01-01", 100.0), (1, "2026-01-02", 200.0), (2, "2026-01-03", 300.0), (3, "2026-01-04", 400.0)]
    got = series.trend_metrics(points, "Date").first()
    assert (got["slope_per_observation"], got["intercept"], got["r_squared"]) == pytest.approx((100, 100, 1))
    assert (got["absolute_change"], got["percentage_change"], got["latest_moving_average"]) == (300, 300, 300)
    assert (got["trend_direction"], got["trend_strength"]) == ("rising", "strong")
    assert (got["peak_date"], got["trough_date"]) == ("2026-01-04", "2026-01-01")


def test_flat_and_short_series(spark):
    flat = spark.createDataFrame([(i, 0.1) for i in range(5)], "year int, y double")
    got = series.trend_metrics(series.series_points(flat, ["y"], "year"), "year").first()
    assert (got["trend_direction"], got["trend_strength"], got["r_squared"], got["slope_per_observation"]) == (
        "flat", "stable", 1.0, 0.0)
    short = spark.createDataFrame([(1, 1.0), (2, 2.0)], "year int, y double")
    got = series.trend_metrics(series.series_points(short, ["y"], "year"), "year").first()
    assert got["status"] == "insufficient_data" and got["sample_size"] == 2 and got["r_squared"] is None


@pytest.mark.parametrize("base", [0.0, 1e9, -1e12])
def test_trends_from_moments_match_plain_regression(spark, base):
    """Both formulations, with and without groups, over gaps, ties, repeated rows and a constant."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i // 3, i, base + i * 0.01 + rng.gauss(0, 1), None if rng.random() < 0.2 else rng.random() * (i % 7), 5.0) for i in range(400)]
    rows += [("c", 1, 1, 2.0, None, 1.0), ("c", 2, 1, 2.0, None, 1.0)] + [("d", 4, 4, base, 1.0, 1.0)] * 50
    df = spark.createDataFrame(rows, "place string, d int, o int, v double, w double, k double").repartition(5)
    for by in ([], ["place"]):
        for exact in (False, True):
            moments = series.series_moments(df, ["v", "w", "k"], "d", ["o"], by, exact=exact)
            got = {(r["place"] if by else None, r["measure"]): r for r in series.trends(moments, "d", by, exact=exact).collect()}
            for group in sorted({r[0] for r in rows}) if by else [None]:
                for at, measure in ((3, "v"), (4, "w"), (5, "k")):
                    kept = sorted((r[1], r[2], r[at]) for r in rows if (not by or r[0] == group) and r[at] is not None)
                    values = [v for _, _, v in kept]
                    if not values:
                        assert (group, measure) not in got
                        continue
                    row = got[group, measure]
                    assert row["sample_size"] == len(values)
                    if len(values) < 3:
                        assert row["status"] == "insufficient_data" and row["last_value"] is None
                        continue
                    slope, r2 = trend_by_hand([v - values[0] for v in values])
                    assert row["r_squared"] == pytest.approx(r2, abs=1e-9)
                    assert row["slope_per_observation"] == pytest.approx(slope, rel=1e-7, abs=1e-12)
                    assert row["intercept"] == pytest.approx(sum(values) / len(values) - slope * (len(values) - 1) / 2, rel=1e-9)
                    assert (row["first_value"], row["last_value"], row["peak_value"], row["trough_value"]) == (values[0], values[-1], max(values), min(values))
                    assert row["peak_date"] == str(next(d for d, _, v in kept if v == max(values)))
                    assert row["latest_moving_average"] == pytest.approx(sum(values[-3:]) / 3)
                    assert row["latest_period_change"] == values[-1] - values[-2]


def test_moments_are_one_row_per_part_and_series(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("day"), F.rand(1).alias("v"), F.lit(1.0).alias("w"))
    moments = series.series_moments(df, ["v", "w"], "day", by=["g"])
    assert moments.count() <= 2 * (2 + int(spark.conf.get("spark.sql.shuffle.partitions")))
