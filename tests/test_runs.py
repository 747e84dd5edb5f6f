"""Sources, profile, protection and whole runs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.functions import fixed
from vouch.operators import privacy, profile, roles
from vouch.operators.insights import EVIDENCE, TREND_FIELDS
from vouch.operators.series import series_points
from vouch.plans import planner
from vouch.plans.pipeline import analyse
from vouch.sources import csv_records, reports, uploads
from vouch.sources.runs import RunStore, duplicate_versions, run_history, version_numbers
from vouch.sources.tables import read_csv, read_table, safe_projection
from vouch.operators import report
from tests.conftest import rows_of

PII = """CustomerName,Email,Phone,Revenue,Cost
Aarav Sharma,aarav@example.com,9876543210,100,60
Diya Patel,diya@example.com,9876543211,120,70
Kabir Mehta,kabir@example.com,9876543212,140,80
Isha Rao,isha@example.com,9876543213,160,90
"""


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('n,f,b,d,s,e\n1,1.5,True,2026-01-02,"x, y",\nNA,2,False,2026-01-03,N/A,\n 7,nan,true,2026-01-01,z,\n')
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert df.orderBy(F.desc_nulls_last("n")).first()["n"] == 7
    assert df.filter("n = 1").first()["s"] == "x, y" and df.filter("s is null").count() == 1
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t.json"))


def test_protected_columns(spark, tmp_path):
    path = tmp_path / "pii.csv"
    path.write_text(PII)
    df = read_table(spark, str(path))
    found = rows_of(privacy.detect(df, profile.column_counts(df)), "column")
    assert {c: r["category"] for c, r in found.items()} == {"CustomerName": "name", "Email": "email", "Phone": "phone"}
    safe = safe_projection(df, found)
    assert safe.columns == ["Revenue", "Cost"]
    assert "Email" not in safe._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_values_tell_without_a_telling_name(spark):
    df = spark.createDataFrame([(f"u{i}@x.org" if i < 8 else "none", 1) for i in range(10)], "Contact string, Salary int")
    assert [(r["column"], r["category"]) for r in privacy.by_value(df).collect()] == [("Contact", "email")]
    few = df.withColumn("Contact", F.when(F.col("Contact") == "u0@x.org", F.lit("gone")).otherwise(F.col("Contact")))
    assert privacy.by_value(few).count() == 0


def test_roles_and_plan(spark):
    names = ["TransactionID", "TransactionDate", "Age", "Revenue", "Cost", "Region", "note", "valid", "estate"]
    df = spark.createDataFrame(
        [(i, f"d{i}", 1.0 * i, 2.0 * i, 3.0, "r", f"text {i}", "x", "y") for i in range(60)], names)
    catalogue = roles.with_roles(profile.profile_columns(df))
    got = {r["column"]: r["role"] for r in catalogue.collect()}
    assert got == {
        "TransactionID": "identifier", "TransactionDate": "date", "Age": "numeric", "Revenue": "measure",
        "Cost": "measure", "Region": "dimension", "note": "unknown", "valid": "identifier", "estate": "dimension",
    }
    plan = planner.build_plan(catalogue)
    counts = {r["type"]: r["analyses"] for r in planner.plan_counts(plan).collect()}
    assert counts == {"descriptive_statistics": 2, "group_comparison": 4, "time_series": 2, "correlation": 3}
    first = plan.orderBy("ord").first()
    assert first["description"] == "Calculate descriptive statistics for Revenue."


def test_profile_and_validation(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 0.5), (2, None, -0.0)], "n int, s string, x double")
    got = rows_of(profile.profile_columns(df), "column")
    assert (got["x"]["missing_count"], got["x"]["missing_percentage"], got["s"]["unique_count"]) == (2, 50.0, 1)
    summary = profile.validation_summary(df).first()
    assert (summary["valid"], summary["row_count"], summary["duplicate_rows"]) == (True, 4, 1)
    assert summary["missing_values"] == {"s": 2, "x": 2}
    assert summary["warnings"] == ["Missing values detected.", "1 duplicate rows detected."]
    empty = profile.validation_summary(df.limit(0)).first()
    assert (empty["valid"], empty["errors"]) == (False, ["Dataset contains no rows."])
    twice = df.toDF("n", "s", "n")
    assert profile.validation_summary(twice).first()["errors"] == ["Duplicate column names found: ['n']"]
    assert [(r["value"], r["n"]) for r in profile.top_values(df).collect()] == [("a", 2)]


def test_upload_triage(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "wide.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "quoted.csv").write_text('a,b\n"1,5",2\n')
    (tmp_path / "empty.csv").write_text("\n")
    (tmp_path / "nul.csv").write_bytes(b"a\x00b\n1\n")
    (tmp_path / "book.xlsx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "fake.xlsx").write_bytes(b"hello")
    (tmp_path / "old.xls").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "nothing at all.csv").write_bytes(b"")
    (tmp_path / "lines.csv").write_text('a,b\n"x\ny,z",1\n')
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n')
    (tmp_path / "late.csv").write_text("a,b\n" + "1,2\n" * 30000 + "1,2,3\n")  # only the first records are judged
    (tmp_path / "broad.csv").write_text("a,b\n" + 'x' * 70000 + ',2\n1,2,3\n')
    got = rows_of(uploads.triage(spark, str(tmp_path)), "name")
    assert {n for n, r in got.items() if r["accepted"]} == {"good.csv", "quoted.csv", "book.xlsx", "old.xls", "lines.csv", "late.csv"}
    assert got["nothing at all.csv"]["length"] == 0 and len(got) == 14
    assert got["note.txt"]["reason"] == "Only CSV and Excel files are supported."
    assert got["fake.xlsx"]["reason"] == "The file content is not a valid XLSX workbook."


def test_versions_and_history(spark):
    log = spark.createDataFrame([("d", "v2", 2), ("d", "v1", 1), ("e", "v3", 9)], "dataset_id string, version_id string, created_at int")
    numbered = version_numbers(log)
    assert {r["version_id"]: r["version_number"] for r in numbered.collect()} == {"v1": 1, "v2": 2, "v3": 1}
    assert duplicate_versions(numbered).isEmpty()
    runs = spark.createDataFrame([("v1", "r1", "completed", 1), ("v1", "r2", "failed", 2)], "version_id string, run_id string, status string, created_at int")
    assert [r["run_id"] for r in run_history(runs, "v1").collect()] == ["r2", "r1"]


def test_whole_run(spark, people, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    salaries = people.withColumn("Salary", F.when(F.col("Age") == 44, F.lit(250000)).otherwise(F.col("Salary")))
    run = analyse(salaries, run_id="r1", version_id="v1", store=store)
    assert run.status == "completed"
    ranked = run.ranked.orderBy("rank").collect()
    assert ranked[0]["title"] == "Potential outliers detected in Salary"
    assert ranked[0]["lineage"]["version_id"] == "v1"
    assert all(r["verification"]["status"] == "verified" for r in ranked)
    assert store.runs().first()["status"] == "completed"
    assert store.run("r1").count() == 1
    with pytest.raises(LookupError):
        store.run("r9")
    assert "run_id=r1" in store.read_stage("ranked", "r1").inputFiles()[0]
    cells = report.report_cells(run.report())
    reports.write_report(cells, str(tmp_path / "report"))
    text = next((tmp_path / "report").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿rank,insight_type,title") and "Potential outliers detected in Salary" in text


def test_run_of_an_empty_table_fails_validation(spark, people):
    assert analyse(people.limit(0), run_id="none").status == "failed"


def test_failed_analysis_is_recorded(spark, people):
    df = people.withColumn("Cost", F.lit(None).cast("double"))
    run = analyse(df, run_id="partial")
    assert run.status == "partially_completed"
    failed = run.outcomes.filter("status = 'failed'").collect()
    assert [(r["type"], r["measure"]) for r in failed] == [("descriptive_statistics", "Cost")]
    assert run.ranked.count() >= 1


def test_run_ids_stay_text(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    for run_id in ("001", "1e3", "1"):
        store.set_status(run_id, "v", None, "completed")
    assert {r["run_id"] for r in store.runs().collect()} == {"001", "1e3", "1"}
    assert store.run("001").count() == 1


def test_report_of_a_run_without_insights(spark, people):
    rows = analyse(people.limit(0), run_id="none").report()
    assert rows.count() == 0 and rows.columns == ["run_id", *fixed.REPORT_COLUMNS]


def test_falsified_results_are_found(spark, people, monkeypatch):
    """A result table that differs from the data makes its insight fail."""
    from vouch.operators import series

    dated = people.withColumn("JoiningDate", F.expr("date_add(date'2020-01-01', cast(EmployeeID as int))"))
    honest = analyse(dated, run_id="honest").insights.filter("insight_type = 'time_series_trend'")
    assert {r["verification"]["status"] for r in honest.collect()} == {"verified"}
    right = series.trends
    fields = {f for f in TREND_FIELDS if EVIDENCE[f] == "double"}

    def wrong(moments, date, by=(), *, exact=False):
        made = right(moments, date, by, exact=exact)
        return made if exact else made.withColumns({f: F.col(f) * 1.001 + 1 for f in fields})

    monkeypatch.setattr(series, "trends", wrong)
    found = analyse(dated, run_id="wrong").insights.filter("insight_type = 'time_series_trend'").collect()
    assert found and {r["verification"]["status"] for r in found} == {"failed"}
    assert all({m["field"] for m in r["verification"]["mismatches"]} == fields for r in found)


def test_falsified_groups_are_found(spark, people, monkeypatch):
    """Groups are checked against the rows: a wrong table fails whatever it claims about itself."""
    from vouch.operators import groups

    right = groups.group_statistics
    more = people.unionByName(people).unionByName(people.withColumn("Salary", F.col("Salary") + 500))
    status = {}
    for name, change in {"mean": lambda df: df.withColumn("mean", F.when(F.col("key") == "IT", F.col("mean") * 3).otherwise(F.col("mean"))),
                         "missing": lambda df: df.filter("key <> 'Marketing'")}.items():
        monkeypatch.setattr(groups, "group_statistics", lambda *a, **k: change(right(*a, **k)))
        found = analyse(more, run_id=name).insights.filter("insight_type = 'group_difference' and source_columns[0] = 'Salary'").collect()
        status[name] = {r["verification"]["status"] for r in found}
    assert status == {"mean": {"failed"}, "missing": {"failed"}}


@pytest.mark.parametrize("level", [1e9, -1e12])
def test_trends_far_from_zero_are_verified(spark, level):
    """Plain sums of squares would cancel here; a trend is sound wherever its values lie."""
    rnd = random.Random(7)
    rows = [(i, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", level + i + rnd.gauss(0, 30)) for i in range(336)]
    df = spark.createDataFrame(rows, "visit_id long, visit_date string, amount double")
    found = analyse(df, run_id="far").insights.filter("insight_type = 'time_series_trend'").collect()
    assert [r["verification"]["status"] for r in found] == ["verified"]
    x, y = np.arange(336.0), np.array([v - level for _, _, v in rows])
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    assert found[0]["evidence"]["r_squared"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-9)
    assert found[0]["calculation"]["slope_per_observation"] == pytest.approx(slope, rel=1e-9)


def test_one_failing_pair_fails_alone(spark, people, monkeypatch):
    from pyspark.errors import ArithmeticException

    from vouch.operators import correlation

    three = people.withColumn("Bonus", F.col("Salary") * 2 + F.col("Age") % 3)
    right = correlation.correlations

    def broken(df, pairs, by=()):
        if ("Age", "Bonus") in pairs:
            raise ArithmeticException("overflow")
        return right(df, pairs, by)

    monkeypatch.setattr(correlation, "correlations", broken)
    run = analyse(three, run_id="one")
    status = {(r["first"], r["second"]): (r["status"], r["error"]) for r in run.outcomes.filter("type = 'correlation'").collect()}
    assert status.pop(("Age", "Bonus")) == ("failed", "overflow")
    assert status and set(status.values()) == {("completed", None)}


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    with pytest.raises(ValueError, match="line break"):
        read_table(spark, str(path), multi_line=False)
    for how in (None, True):
        assert sorted(r["b"] for r in read_table(spark, str(path), multi_line=how).collect()) == ["x\ny", "z"]


def test_profiles_without_columns_of_a_kind(spark):
    numbers, texts = spark.range(3).toDF("n"), spark.createDataFrame([("a",)], "t string")
    assert profile.top_values(numbers).count() == 0 and profile.profile_numeric(texts).count() == 0


def test_points_are_the_same_at_every_size(spark):
    rows = [("2020-01-01", 5.0)] * 5 + [("2020-01-02", 7.0), ("2020-01-03", None)]
    df = spark.createDataFrame(rows, "d string, v double")
    forms = [sorted(map(tuple, series_points(df, ["v"], "d", direct_rows=n).collect())) for n in (0, 10**6)]
    assert forms[0] == forms[1] and len(forms[0]) == 2 and forms[0][0][4] == 5


def test_records_over_many_blocks(spark, tmp_path):
    """Blocks of a few bytes, values with line breaks, commas, doubled and stray quotes."""
    rnd = random.Random(11)
    bits = ["a", ",", "\n", '"', '""', " ", "5\"", "long text", "\n\n", "é"]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    want = []
    for k in range(3):
        rows = [["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(3)] for _ in range(60)]
        with open(folder / f"f{k}.csv", "w", newline="") as file:
            file.write("x,y,z\n")
            for i, row in enumerate(rows):
                cells = [c if i % 3 == 0 and c[:1] not in ('"', "") and not set(c) & set(",\n\r") else '"' + c.replace('"', '""') + '"' for c in row]
                file.write(",".join(cells) + "\n")
        want += [tuple(c or None for c in row) for row in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("40b", "700b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [tuple(c or None for c in r) for r in csv_records.read_records(spark, str(folder)).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "stray.csv").write_text('what,n\n5" pipe,1\n"6"" pipe",2\n')
    assert not csv_records.has_line_breaks(spark, str(tmp_path / "stray.csv"))
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "stray.csv")).orderBy("n").collect()] == [('5" pipe', 1), ('6" pipe', 2)]
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="never closed"):
        read_table(spark, str(tmp_path / "open.csv"))


def test_cells_of_a_scan_are_folded_in_pieces(spark):
    """A task held all its distinct values before; now it passes on what it has after so many cells."""
    import numpy as np
    import pyarrow as pa

    from vouch.operators import profile

    read = []

    def batches():
        rng = np.random.default_rng(3)
        for i in range(40):
            read.append(i)
            cells = [rng.integers(0, 3, 100).astype(np.int32), rng.integers(-4, 4, 100), rng.integers(0, 2, 100)]
            seen.extend(zip(*(c.tolist() for c in cells)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["ord", "a", "b"])

    seen: list = []
    found: dict = {}
    ahead = []
    for piece in profile.folded_cells(batches(), most=500):
        ahead.append(len(read))
        for o, a, b, n in zip(*(c.to_pylist() for c in piece.columns)):
            found[o, a, b] = found.get((o, a, b), 0) + n
    assert found == {cell: seen.count(cell) for cell in set(seen)}
    assert ahead == list(range(5, 41, 5))
    df = spark.createDataFrame([(i % 7 or None, float(i % 3), f"t{i}") for i in range(500)], "a int, b double, c string")
    got = {r["ord"]: (r["non_null"], r["unique_count"]) for r in profile.hashed_counts(df).collect()}
    assert got == {-1: (500, 1), 0: (428, 6), 1: (500, 3), 2: (500, 500)}


def test_written_tables_get_tasks_by_their_rows(spark):
    from vouch.session import TASK_ROWS, tasks_for

    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    with tasks_for(spark, 9 * TASK_ROWS + 1):
        assert spark.conf.get(name) == "10"
    with tasks_for(spark, 1):
        assert spark.conf.get(name) == given
    assert spark.conf.get(name) == given


def test_runs_are_correlated_without_a_join_and_keep_empty_pairs(spark):
    """The pairs of a run came by a join of two shuffled tables; rows without both values count for none."""
    from vouch.operators.correlation import correlations

    rows = [("a", float(i), 2.0 * i, None) for i in range(5)] + [(None, 1.0, None, 3.0), (None, 2.0, 1.0, 4.0)] + [("c", None, None, None)]
    df = spark.createDataFrame(rows, "run string, x double, y double, z double")
    made = correlations(df, [("x", "y"), ("x", "z")], ["run"])
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["run"], r["second"]): (r["sample_size"], r["correlation"], r["status"]) for r in made.collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", "y"): 5, ("a", "z"): 0, (None, "y"): 1, (None, "z"): 2, ("c", "y"): 0, ("c", "z"): 0}
    assert abs(got["a", "y"][1] - 1) < 1e-9 and got["a", "z"][2] == "insufficient_data" and abs(got[None, "z"][1] - 1) < 1e-9
