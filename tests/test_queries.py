import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a03_dense_grouping", "a11_mutual_information", "c05_festival_season", "io07_forecast_folder", "j01_calendar_join", "m07_autoregression", "p12_classify_flags", "q06_overall_performance", "w07_ewm"]
NAMES = sorted(entry_points.oracle_sql()) if os.environ.get("CHECK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, base, name):
    assert compare(entry_points.queries()[name](spark, FOLDER), base.sql(entry_points.oracle_sql()[name])) is None
