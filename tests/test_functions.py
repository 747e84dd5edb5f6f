from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vouch.functions import numbers, special, text
from vouch.functions.scores import confidence_level, p_value_score, sample_size_score


def test_pearson_p_value_matches_published_number(spark):
    df = spark.createDataFrame([(0.9881836853586583, 12.0), (0.4, 2.0), (-1.0, 9.0), (0.0, 9.0), (None, 9.0)], "r double, n double")
    out = [row["p"] for row in special.with_pearson_p(df, "p", "r", "n").collect()]
    assert out[0] == pytest.approx(1.7786420755e-09, rel=1e-10)
    assert out[1:] == [1.0, 0.0, 1.0, None]


@pytest.mark.parametrize("d2", [4.0, 15.0, 600.0, 599997.0, 1e9])
def test_f_tail_has_its_closed_forms(spark, d2):
    """Two numerator degrees of freedom, and four, have elementary tails."""
    f_values = [0.01, 0.5, 1.3, 8.0, 60.0]
    df = spark.createDataFrame([(f, d1, d2) for f in f_values for d1 in (2.0, 4.0)], "f double, d1 double, d2 double")
    for row in special.with_f_tail(df, "p", "f", "d1", "d2").collect():
        x = d2 / (d2 + row["d1"] * row["f"])
        a = d2 / 2
        exact = math.exp(a * math.log(x))
        if row["d1"] == 4.0:
            exact *= 1 + a * (1 - x)
        assert row["p"] == pytest.approx(exact, rel=1e-7, abs=1e-300)


def test_f_tail_at_the_edges(spark):
    df = spark.createDataFrame([(math.inf, 2.0, 9.0), (1e5, 2.0, 1e5), (None, 2.0, 9.0)], "f double, d1 double, d2 double")
    assert [row["p"] for row in special.with_f_tail(df, "p", "f", "d1", "d2").collect()] == [0.0, 0.0, None]


def test_canonical_number_and_text(spark):
    cases = [
        (0.9999999999999999, "1.0"), (74.46800000000001, "74.468"), (1.4857e-07, "1.4857e-07"), (0.0, "0.0"),
        (1e-9, "1e-09"), (12345678.25, "12345678.25"), (1e16, "1e+16"), (-0.00012, "-0.00012"), (312.5, "312.5"),
    ]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x double").withColumn("c", numbers.canonical("x"))
    assert [row[0] for row in df.select(numbers.number_text("c")).collect()] == [t for _, t in cases]


def test_numbers_in_text(spark):
    said = "1. First 3.5\n  2. then -4e3 on 2026-01-02\n10.5 a1b"
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(numbers.numbers_in("t")).first()[0] == [3.5, -4000.0, 2026.0, -1.0, -2.0, 10.5, 1.0]


def test_tolerance(spark):
    pairs = [(1.0, 1.0 + 5e-7), (1.0, 1.00001), (None, None), (None, 0.0), (math.inf, math.inf), (math.inf, 1.0), (1e9, 1e9 + 500)]
    df = spark.createDataFrame(pairs, "a double, b double")
    out = [row[0] for row in df.select(F.expr(numbers.close_sql("a", "b"))).collect()]
    assert out == [True, False, True, False, True, False, True]


def test_scores(spark):
    df = spark.createDataFrame([(None, None), (4, 0.2), (9, 0.09), (29, 0.049), (99, 0.009), (100, 0.0)], "n int, p double")
    out = df.select(sample_size_score(F.col("n")), p_value_score(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0), (0.2, 0.0), (0.4, 0.4), (0.6, 0.75), (0.8, 0.9), (1.0, 1.0)]
    levels = spark.createDataFrame([(0.8,), (0.79,), (0.6,), (0.59,)], "s double").select(confidence_level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["high", "medium", "medium", "low"]


def test_text_rules(spark):
    df = spark.createDataFrame([
        ("=1+1", "'=1+1"), ("-5", "'-5"), ("plain", "plain"), (None, ""), ("@x", "'@x")], "t string, want string")
    assert all(r[0] for r in df.select(text.spreadsheet_safe(F.col("t")) == F.col("want")).collect())
    report = spark.createDataFrame([("# Head\n**bold** and\n  * item\n---\n",)], "t string")
    assert report.select(text.plain_report_text(F.col("t"))).first()[0] == "Head\nbold and\n- item"
    log = spark.createDataFrame([("key s3cret; bearer abc.DEF-1 end",)], "t string")
    assert log.select(text.redact(F.col("t"), ["s3cret"])).first()[0] == "key [REDACTED]; Bearer [REDACTED] end"


def test_json_cells_are_those_of_the_json_library(spark):
    import json

    from vouch.functions.text import json_sql

    schema = "v struct<b: double, a: string, n: bigint, ok: boolean, parts: array<string>, d: double>"
    numbers = [0.0, -0.0, 1.0, 0.1, 123456789.125, 1e7, 1e15, 1e16, 1.5e300, 1e-4, 9.9e-5, 1.7786420755e-09, -2.5, 0.988183685359, 2.5e-308]
    values = [{"b": x, "a": 'quote " slash \\ tab\t é', "n": i, "ok": i % 2 == 0, "parts": ["x", "ü\n"], "d": None} for i, x in enumerate(numbers)]
    df = spark.createDataFrame([(v,) for v in values], schema)
    got = [r[0] for r in df.select(F.expr(json_sql("v", df.schema["v"].dataType))).collect()]
    assert got == [json.dumps({k: x for k, x in v.items() if x is not None}, ensure_ascii=False, sort_keys=True) for v in values]
