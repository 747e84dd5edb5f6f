"""Every registered query against its SQL twin on the smallest driver tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from vouch.functions import fixed
from workload import rules

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, str):
        return value
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    return repr(float(value))


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(row[i]) for i in order) for row in rows)


# The training-data queries have tests of their own, some of them without SQL.
OWN = sorted(n for n, f in queries().items() if f.__module__.startswith("workload."))


def test_every_query_has_sql():
    assert set(OWN) <= set(oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, FOLDER)
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert canonical(got.columns, got.collect()) == canonical(names, want.fetchall())


def test_entry(spark):
    assert entry(spark).count() >= 1


def test_uploads_stay_below_the_size_limit(spark, monkeypatch):
    """A segment of more bytes than one file may have comes as several files."""
    monkeypatch.setattr(fixed, "MAX_UPLOAD_BYTES", 1000)
    monkeypatch.setattr(rules, "UPLOAD_ROWS", 10, raising=False)
    got = {r["folder"]: (r["accepted"], r["reason"]) for r in rules.upload_triage(spark, FOLDER).collect()}
    text = got.pop("text")
    assert len(got) == 5 and set(got.values()) == {(True, None)}
    assert text == (False, "Only CSV and Excel files are supported.")
