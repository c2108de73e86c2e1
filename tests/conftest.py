import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series_of(spark):
    """Frame of (location, ds, y) from lists of values, one day per value."""

    def build(start="2024-01-01", **values):
        first = dt.date.fromisoformat(start)
        rows = [(k, first + dt.timedelta(days=i), v) for k, vs in values.items() for i, v in enumerate(vs)]
        kind = "double" if any(isinstance(r[2], float) for r in rows) else "int"
        return spark.createDataFrame(rows, f"location string, ds date, y {kind}")

    return build


@pytest.fixture(scope="session")
def column():
    """Values of one column in series and day order."""

    def read(df, name, order=("location", "ds")):
        return [r[name] for r in df.orderBy(*order).collect()]

    return read
