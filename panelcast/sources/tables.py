"""Views over the order and event tables that stand for the panel inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import is_weekend
from ..operators import clean, panel
from ..operators.keys import lookup

# Severity per priority, 1 for anything else; place names for the
# regions, with one left unknown; days between the order and the holiday years.
PRIORITY_SEVERITY = {"1-URGENT": 3, "2-HIGH": 3, "3-MEDIUM": 2}
CITY_OF_REGION = {"AFRICA": "Can Tho", "AMERICA": "Ha Noi", "ASIA": "Ho Chi Minh City", "EUROPE": "Da Nang"}
DAY_SHIFT = 9496


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customers_with_place(spark: SparkSession, folder: str, place: str = "r_name") -> DataFrame:
    """Customer key, place and balance; the two small tables are joined first."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col(place).alias("location"))
    customer = table(spark, folder, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", "location", "c_acctbal")


def episodes(spark: SparkSession, folder: str, place: str = "r_name") -> DataFrame:
    """One row per order: day, place, priority as condition, age from the balance."""
    orders, people = table(spark, folder, "orders"), customers_with_place(spark, folder, place)
    return orders.join(people, orders.o_custkey == people.c_custkey).select(
        F.to_date("o_orderdate").alias("date"),
        "location",
        F.col("o_orderpriority").alias("disease_type"),
        ((F.col("c_acctbal") + 1000) / 100).alias("age"),
        F.col("o_orderkey").alias("order_id"),
    )


def grouped_episodes(spark: SparkSession, folder: str, place: str = "r_name") -> DataFrame:
    return episodes(spark, folder, place).withColumn("age_group", clean.bin_half_open(F.col("age")))


def admissions(spark: SparkSession, folder: str, place: str = "r_name") -> DataFrame:
    """Counts by day, place, condition and age group, with severity.

    Orders are counted per customer, day and priority before the join, so a
    customer with a large share of all orders brings a few rows per day to it.
    """
    orders, people = table(spark, folder, "orders"), customers_with_place(spark, folder, place)
    day, kind = F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("disease_type")
    counted = orders.groupBy("o_custkey", day, kind).agg(F.count("*").alias("n"))
    age = clean.bin_half_open((F.col("c_acctbal") + 1000) / 100)
    joined = counted.join(people, counted.o_custkey == people.c_custkey).withColumn("age_group", age)
    keys = ["date", "location", "disease_type", "age_group"]
    counts = joined.na.drop(subset=keys).groupBy(*keys).agg(F.sum("n").alias("admission_count"))
    return counts.withColumn("disease_severity", severity(F.col("disease_type")))


def severity(condition: Column) -> Column:
    return lookup(condition, PRIORITY_SEVERITY, 1)


def daily(spark: SparkSession, folder: str, place: str = "r_name") -> DataFrame:
    return panel.daily_totals(admissions(spark, folder, place))


def series(spark: SparkSession, folder: str, place: str = "r_name") -> DataFrame:
    """Gap-free daily series per place."""
    return panel.fill_date_gaps(daily(spark, folder, place))


def city_series(spark: SparkSession, folder: str) -> DataFrame:
    """The series under known place names, moved into the years of the holiday calendar."""
    named = series(spark, folder).withColumn("location", F.coalesce(lookup(F.col("location"), CITY_OF_REGION), F.col("location")))
    moved = named.withColumn("ds", F.date_add("ds", DAY_SHIFT))
    return moved.withColumns({"is_weekend": is_weekend(F.col("ds")), "month": F.month("ds")})


def event_flags(spark: SparkSession, folder: str) -> DataFrame:
    """0/1 column per event type for every user and day."""
    events = table(spark, folder, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    marks = [F.max((F.col("event_type") == k).cast("int")).alias(k) for k in kinds]
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(*marks)


def returns(spark: SparkSession, folder: str) -> DataFrame:
    """Returned and shipped lines per ship date."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.to_date("l_shipdate").alias("ds")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("total")
    )


def supplier_beds(spark: SparkSession, folder: str) -> DataFrame:
    """Beds per region: ten per supplier, a tenth of them intensive care."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("location"))
    supplier = table(spark, folder, "supplier")
    counts = supplier.join(places, supplier.s_nationkey == places.n_nationkey).groupBy("location").agg(F.count("*").alias("n"))
    return counts.select("location", (F.col("n") * 10).alias("total_beds"), F.col("n").alias("icu_beds"))


def dirty_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """The admissions with copies, negative, missing, extreme and future rows mixed in.

    Each row unrolls into itself and the faulty versions it gives rise to, so
    the tables are read once.
    """
    kind, count, day, place, age = (F.col(c) for c in ("disease_type", "admission_count", "date", "location", "age_group"))
    nothing = F.lit(None).cast("string")

    def row(date=day, disease_type=kind, age_group=age, admission_count=count) -> Column:
        parts = {"date": date, "location": place, "disease_type": disease_type, "age_group": age_group, "admission_count": admission_count}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    versions = [
        row(),
        F.when(kind == "1-URGENT", row()),
        F.when(kind == "5-LOW", row(disease_type=nothing, age_group=nothing, admission_count=-count)),
        F.when((kind == "2-HIGH") & (F.dayofmonth(day) == 1), row(disease_type=nothing, admission_count=count * 1000)),
        F.when(kind == "3-MEDIUM", row(date=F.date_add(day, 36525), age_group=nothing)),
        F.when((kind == "4-NOT SPECIFIED") & (F.month(day) == 1), row(admission_count=F.lit(None).cast("long"))),
    ]
    return admissions(spark, folder).select(F.inline(F.array_compact(F.array(*versions))))


def day_capacity(spark: SparkSession, folder: str) -> DataFrame:
    """Capacity with noise read off the day number, so that SQL can repeat it."""
    noise = (F.unix_date("date") % 201) / 100 - 1
    return panel.capacity_table(admissions(spark, folder), noise=noise)
