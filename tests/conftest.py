"""One Spark session for all tests and DuckDB over the same tables."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value) -> str:
    """A value as text, equal for both engines."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def compare(frame, sql: str) -> None:
        found = duck.sql(sql)
        columns = sorted(found.columns)
        assert sorted(frame.columns) == columns
        ours = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
        theirs = sorted(tuple(plain(dict(zip(found.columns, row))[c]) for c in columns) for row in found.fetchall())
        assert ours == theirs

    return compare
