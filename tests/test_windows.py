import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from panelcast.operators import holidays, keys, panel, windows
from panelcast.operators.features import all_features


def approx(values):
    return [None if v is None or pd.isna(v) else pytest.approx(v, abs=1e-9) for v in values]


def test_ewm_literal(series_of, column):
    got = column(windows.ewm_columns(series_of(a=[1, 3, 2, 8]), (0.5,)), "y_ema_0.5")
    assert got == approx([1, 7 / 3, 15 / 7, 79 / 15])


def test_ewm_matches_pandas_over_several_blocks(series_of, column):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, 1300).tolist(), rng.integers(0, 9, 40).tolist()
    out = windows.ewm_columns(series_of(a=a, b=b)).cache()
    for alpha in windows.ALPHAS:
        expected = [*pd.Series(a).ewm(alpha=alpha).mean(), *pd.Series(b).ewm(alpha=alpha).mean()]
        assert column(out, f"y_ema_{alpha}") == approx(expected)


def test_ewm_skips_nulls_like_pandas(spark, series_of, column):
    values = [None, 2.0, None, 5.0, 1.0, None]
    got = column(windows.ewm_columns(series_of(a=values), (0.3,)), "y_ema_0.3")
    assert got == approx(pd.Series(values).ewm(alpha=0.3).mean())


def test_leak_free_std(series_of, column):
    out = windows.rolling_columns(series_of(a=[1, 3, 2, 8]), (2,), ("std",), "r_", full=False, shift=1)
    assert column(out, "r_std_2") == approx([None, None, 2**0.5, 0.5**0.5])


def test_full_and_partial_frames_match_pandas(series_of, column):
    y = [5, 1, 4, 4, 8, 2, 9, 7]
    rolled = windows.rolling_columns(series_of(a=y), (3,))
    for stat in ("mean", "std", "min", "max"):
        assert column(rolled, f"y_rolling_{stat}_3") == approx(getattr(pd.Series(y).rolling(3), stat)())
    assert column(windows.moving_averages(series_of(a=y), (3,)), "ma_3_days") == approx(pd.Series(y).rolling(3, min_periods=1).mean())


def test_forward_average_and_increase(series_of, column):
    df = series_of(a=[1, 2, 3, 4])
    assert column(windows.forward_average(df, "y", "f", 3, "location"), "f") == approx([2, 3, 3.5, 4])
    assert column(windows.daily_increase(df, "y", "d", "location"), "d") == [1, 1, 1, 1]


def test_fill_stays_inside_its_series(series_of, column):
    df = series_of(a=[None, 1, None, 2], b=[None, None, 7, None])
    assert column(windows.fill_forward_back(df, ["y"]), "y") == [1, 1, 1, 2, 7, 7, 7, 7]


def test_split_marks_the_last_rows(series_of, column):
    assert column(windows.split_last_rows(series_of(a=[1] * 5, b=[1] * 2), 3), "is_test") == [False, False, True, True, True, True, True]


def test_series_do_not_leak_into_each_other(series_of, column):
    assert column(windows.lag_columns(series_of(a=[1, 2], b=[3, 4]), (1,)), "lag_1") == [None, 1, None, 3]


def test_holiday_neighbourhood(series_of):
    rows = holidays.holiday_effects(series_of("2023-08-28", a=[1] * 10)).orderBy("ds").collect()
    got = [(r.pre_holiday, r.on_holiday, r.post_holiday, r.is_national_day) for r in rows]
    assert got == [(0, 0, 0, 0)] * 2 + [(1, 0, 0, 0)] * 3 + [(0, 1, 0, 1)] + [(0, 0, 1, 0)] * 3 + [(0, 0, 0, 0)]


def test_festival_season_reaches_fourteen_days_back_and_seven_ahead(series_of, column):
    marks = column(holidays.holiday_effects(series_of("2024-01-20", a=[1] * 40)), "is_tet_season")
    assert marks == [0] * 7 + [1] * (14 + 5 + 7) + [0] * 7


def test_holidays_given_as_data_equal_the_built_in_calendar(spark, series_of):
    df = series_of("2023-04-20", a=[1] * 30)
    given = holidays.holiday_effects(df, holidays.holiday_table(spark))
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, holidays.holiday_effects(df).collect()))


def test_feature_frame_keeps_rows_and_has_no_gaps(spark, series_of):
    from pyspark.sql import functions as F

    y = [(i * 7) % 23 + 1 for i in range(120)]
    df = series_of("2023-01-01", **{"Ha Noi": y, "Hue": y[::-1]})
    df = df.withColumns({"is_weekend": (F.weekday("ds") >= 5).cast("int"), "month": F.month("ds"), "disease_severity": F.lit(1.5)})
    out = all_features(df)
    assert out.count() == df.count()
    assert len(out.columns) == 100  # the 99 columns and on_holiday
    row = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in out.columns]).first()
    assert sum(row) == 0


def test_old_values_survive_long_gaps(spark):
    days = [(1, i, 10.0 if i == 0 else None) for i in range(2001)]
    df = spark.createDataFrame(days, "location long, ds int, y double")
    out = windows.ewm_columns(df, (0.1, 1.0)).orderBy("ds").collect()
    assert out[-1]["y_ema_0.1"] == pytest.approx(10.0) and out[-1]["y_ema_1.0"] == 10.0


def test_totals_beyond_32_bits(spark):
    rows = [("a", dt.date(2024, 1, 1), 3_000_000_000, 1.0), ("a", dt.date(2024, 1, 3), 3_000_000_002, 1.0)]
    filled = panel.fill_date_gaps(spark.createDataFrame(rows, "location string, ds date, y long, disease_severity double"))
    assert [r.y for r in filled.orderBy("ds").collect()] == [3_000_000_000, 3_000_000_001, 3_000_000_002]
    sparse = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in ((1, 3_000_000_000), (2, None), (3, 3_000_000_004))], "location string, ds date, y long")
    assert [r.y for r in windows.interpolate(sparse).orderBy("ds").collect()] == [3_000_000_000, 3_000_000_002, 3_000_000_004]


def test_row_numbers_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = keys.row_index(df.repartition(20), "k").collect()
    assert all(r.k == r.row_index for r in rows) and len(rows) == 5000
