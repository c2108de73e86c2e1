import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions import text
from panelcast.operators import clean, features
from panelcast.operators.keys import row_index


def labels(spark, expression, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_half_open_bins(spark):
    assert labels(spark, clean.bin_half_open, [0, 17.9, 18, 65, 119, 120, -1]) == ["0-18", "0-18", "19-30", "65+", "65+", None, None]


def test_right_closed_bins(spark):
    bins = lambda v: clean.bin_right_closed(v, (0, 1500, 3000, 10000), ("small", "medium", "large"))
    assert labels(spark, bins, [0, 1500, 3000, 9000, 10000]) == [None, "small", "medium", "large", "large"]


def test_day_first_parse(spark):
    df = spark.createDataFrame([("4/1/2017",), ("4/13/2017",), ("12/3/2019",)], "t string")
    assert [r[0] for r in df.select(text.lenient_date(F.col("t"))).collect()] == [dt.date(2017, 1, 4), None, dt.date(2019, 3, 12)]


def test_clean_steps(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, "a", "x", "0-18", 10 + i % 3) for i in range(30)] + [(day, f"p{i}", None, None, 10 + i % 5) for i in range(60)]
    rows += [(day, "a", "x", "0-18", -1), (day, "a", "x", "0-18", None), (day, "b", "x", "0-18", 9999), (dt.date(2999, 1, 1), "a", "x", "0-18", 10)]
    df = spark.createDataFrame(rows, "date date, location string, disease_type string, age_group string, admission_count int")
    kept = clean.clean(df)
    assert kept.count() == 3 + 60
    assert kept.filter("disease_type = 'Unknown' and age_group = 'Unknown'").count() == 60
    audit = clean.removal_audit(df, kept).first()
    assert (audit.initial_rows, audit.final_rows, audit.removed_rows, audit.half_removed) == (94, 63, 31, False)


def test_classify_first_set_flag_in_column_order(spark):
    df = spark.createDataFrame(
        [(1, "0", "1", "1", None), (2, "yes", "0", "1", None), (3, "0", "0", "0", "acute cva"), (4, None, " true ", None, None), (5, "no", "n", "0", None)],
        "id int, DM string, DVT string, CKD string, FINAL_DIAGNOSIS string",
    )
    by_word = dict(df.select("id", clean.classify_flags(df)).collect())
    assert by_word == {1: "Blood Clot", 2: "Diabetes", 3: "Stroke", 4: "Blood Clot", 5: "Heart Disease"}
    by_part = dict(df.select("id", clean.classify_flags(df, substring=True)).collect())
    assert by_part[1] == "Heart Disease"


def test_date_column_discovery():
    assert clean.find_date_column(["x", "DOA", "date"]) == "DOA"
    assert clean.find_date_column(["x", "Discharge Date"]) == "Discharge Date"
    assert clean.find_date_column(["x"]) is None


def test_stand_in_dates_need_an_order(spark):
    df = spark.range(5)
    with pytest.raises(ValueError):
        clean.parse_record_dates(df)
    days = [r.parsed_date for r in clean.parse_record_dates(df, order="id").orderBy("id").collect()]
    assert days == [dt.date(2017, 4, 1) + dt.timedelta(days=i) for i in range(5)]


def test_weighted_assignment_follows_shares(spark):
    places = spark.range(100).select(clean.assign_weighted(F.col("id")).alias("p")).groupBy("p").count().collect()
    assert {r.p: r["count"] for r in places} == dict(zip(clean.PLACES, clean.PLACE_SHARES))


def test_rural_assignment_stays_in_its_group(spark):
    df = spark.range(60).withColumn("RURAL", F.expr("CASE id DIV 20 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END"))
    rows = df.select("RURAL", clean.assign_rural_urban(F.col("RURAL"), F.col("id")).alias("p")).collect()
    assert {r.p for r in rows if r.RURAL == "yes"} == set(clean.RURAL_PLACES)
    assert {r.p for r in rows if r.RURAL == "no"} == set(clean.URBAN_PLACES)
    assert {r.p for r in rows if r.RURAL is None} <= set(clean.PLACES)


def test_records_to_admission_schema(spark):
    df = spark.createDataFrame(
        [(1, "4/1/2017", "81", "1", "R"), (2, "4/13/2017", "20", "0", "U"), (3, "5/1/2017", "n/a", "0", "U")],
        "id int, `D.O.A` string, AGE string, CVA string, RURAL string",
    )
    rows = clean.to_admission_records(df, "id").orderBy("date").collect()
    assert [(r.date, r.disease_type, r.age_group) for r in rows] == [
        (dt.date(2017, 1, 4), "Stroke", "65+"),
        (dt.date(2017, 1, 5), "Heart Disease", "31-50"),
    ]


@pytest.mark.parametrize("rows", [1, 7, 5000])
def test_row_index_is_consecutive(spark, rows):
    df = spark.range(rows).select((F.col("id") * F.col("id") * 7 % 1000003 * 100000 + F.col("id")).alias("k"))
    numbered = row_index(df, "k").orderBy("k").collect()
    assert [r.row_index for r in numbered] == list(range(rows))


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    assert {r.v: r.v_code for r in features.encode_labels(df, "v").collect()} == {"a": 0, "b": 1, "c": 2, None: None}


def test_fill_with_mean(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 4), (3.0, None)], "`a.b` double, c int")
    rows = features.fill_with_mean(df, ["a.b", "c"]).collect()
    assert [(r[0], r[1]) for r in rows] == [(1.0, 2.0), (2.0, 4.0), (3.0, 3.0)]
