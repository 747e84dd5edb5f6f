from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def people(spark):
    """Twelve employees whose salary follows their age."""
    salaries = [45000, 47000, 49000, 60000, 62000, 64000, 70000, 72000, 74000, 80000, 82000, 84000]
    teams = ["HR"] * 3 + ["IT"] * 3 + ["Finance"] * 3 + ["Marketing"] * 3
    rows = [(1001 + i, 22 + 2 * i, salary, team) for i, (salary, team) in enumerate(zip(salaries, teams))]
    return spark.createDataFrame(rows, "EmployeeID long, Age long, Salary long, Department string")


def rows_of(df, *keys):
    """Rows as a dict by key columns."""
    return {tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]: row for row in df.collect()}
