import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from panelcast.operators import panel, windows


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_dense_grouping_size_and_zeros(spark):
    rows = [("p", day(0), "x", "0-18"), ("q", day(1), "y", "0-18"), ("q", day(1), "y", "0-18")]
    df = spark.createDataFrame(rows, "location string, date date, disease_type string, age_group string")
    dense = panel.dense_counts(df, domains={"age_group": ["0-18", "19-30", "65+"]})
    assert dense.count() == 24
    assert dense.agg(F.sum("admission_count")).first()[0] == 3
    assert dense.filter("admission_count > 0").count() == 2


def test_dense_grouping_joins_without_cartesian_product(spark, capsys):
    df = spark.createDataFrame([("p", day(0), "x", "0-18")], "location string, date date, disease_type string, age_group string")
    panel.dense_counts(df).explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_records_without_key_or_day_are_left_out(spark):
    rows = [("p", day(0), 1, 1), (None, day(0), 5, 1), ("p", None, 7, 1)]
    df = spark.createDataFrame(rows, "location string, date date, admission_count int, disease_severity int")
    assert [tuple(r)[:3] for r in panel.daily_totals(df).collect()] == [("p", day(0), 1)]


def test_a_hot_key_is_one_row_per_day_after_counting(spark):
    keys = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    df = spark.range(30_000).select(keys.alias("location"), F.date_add(F.lit(day(0)), (F.col("id") % 40).cast("int")).alias("date"), F.lit(1).alias("admission_count"), F.lit(1).alias("disease_severity"))
    totals = panel.daily_totals(df)
    assert totals.groupBy("location").count().agg(F.max("count")).first()[0] <= 40
    assert totals.agg(F.sum("y")).first()[0] == 30_000


def test_gap_filling_shuffles_once(spark, capsys):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(3), 2)], "location string, ds date, y long")
    windows.lag_columns(windows.moving_averages(panel.fill_date_gaps(df))).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1


def test_gaps_are_interpolated_half_even(spark):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(3), 2), ("b", day(1), 5)], "location string, ds date, y long")
    rows = panel.fill_date_gaps(df).orderBy("location", "ds").collect()
    assert [(r.location, r.ds, r.y) for r in rows] == [("a", day(0), 1), ("a", day(1), 1), ("a", day(2), 2), ("a", day(3), 2), ("b", day(1), 5)]
    middle = spark.createDataFrame([("a", day(0), 1), ("a", day(2), 2), ("b", day(0), 2), ("b", day(2), 3)], "location string, ds date, y long")
    assert [r.y for r in panel.fill_date_gaps(middle).filter(F.col("ds") == day(1)).orderBy("location").collect()] == [2, 2]


def test_interpolation_of_nulls_matches_pandas(spark, series_of, column):
    values = [None, 4, None, None, 9, None, 3, None, None]
    df = spark.createDataFrame([("a", day(i), v) for i, v in enumerate(values)], "location string, ds date, y int")
    expected = pd.Series(values, dtype=float).interpolate(method="linear").bfill().round().astype(int).tolist()
    assert column(windows.interpolate(df), "y") == expected


def test_fused_fill_equals_join_then_interpolate(spark):
    rows = [(k, day(i * i % 97 + j), (i * 37 + j) % 50) for j, k in enumerate("ab") for i in range(9)]
    df = spark.createDataFrame(rows, "location string, ds date, y long").dropDuplicates(["location", "ds"])
    fused = panel.fill_date_gaps(df).select("location", "ds", "y")
    apart = windows.interpolate(panel.calendar_join(df)).select("location", "ds", "y")
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, apart.collect()))
    spans = df.groupBy("location").agg((F.datediff(F.max("ds"), F.min("ds")) + 1).alias("n"))
    assert fused.count() == spans.agg(F.sum("n")).first()[0]


def test_capacity_is_reproducible_and_bounded(spark):
    df = spark.createDataFrame([(p, day(i)) for p in ("Punjab Rural", "other") for i in range(30)], "location string, date date")
    first, second = (sorted(map(tuple, panel.capacity_table(df).collect())) for _ in range(2))
    assert first == second and len(first) == 60
    assert all(0.949 * r[2] <= r[4] <= 1.051 * r[2] for r in first)
    assert {r[0]: r[2:4] for r in first} == {"Punjab Rural": (200, 20), "other": (300, 30)}


def test_rate_and_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 6), "Hue", 2, 3)], "date date, location string, admission_count int, disease_severity int")
    row = panel.daily_panel(df).first()
    assert (row.population, row.admissions_per_100k, row.is_weekend, row.week_of_year, row.day_of_week) == (400000, 0.5, 1, 1, 5)
