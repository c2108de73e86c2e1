"""From records to dense daily series.

Records are counted per day first, with map-side partial aggregation, so a hot
key costs one row per day and task in the shuffle. Everything after that works
on panels whose series are no longer than the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import calendar_parts, is_weekend
from .keys import add, as_list, lookup, series_window

# Persons per place, and the number taken for other places.
POPULATION = {
    "Ho Chi Minh City": 9000000,
    "Ha Noi": 8000000,
    "Da Nang": 1200000,
    "Can Tho": 1200000,
    "Hai Phong": 2000000,
    "Nha Trang": 400000,
    "Hue": 400000,
    "Vung Tau": 300000,
    "Bien Hoa": 1000000,
    "Thu Dau Mot": 500000,
}
DEFAULT_POPULATION = 500000

# Total and intensive-care beds per place, and for other places.
BASE_BEDS = {
    "Ludhiana Central": (500, 50),
    "Ludhiana South": (300, 30),
    "Ludhiana North": (250, 25),
    "Punjab Rural": (200, 20),
    "Punjab Urban": (350, 35),
}
DEFAULT_BEDS = (300, 30)
BED_NOISE = 0.05


def count_records(df: DataFrame, keys: Sequence[str], name: str = "admission_count") -> DataFrame:
    """Records per key combination; records with a missing key are left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))


def distinct_values(df: DataFrame, column: str) -> Column:
    """Sorted distinct values as a scalar array, for domains such as days or labels."""
    return df.agg(F.array_sort(F.collect_set(column))).scalar()


def dense_counts(
    df: DataFrame,
    keys: Sequence[str] = ("location", "date", "disease_type", "age_group"),
    domains: Mapping[str, Sequence] | None = None,
    name: str = "admission_count",
) -> DataFrame:
    """Counts for every combination of key values, zero where nothing occurred.

    The first key spreads the work; the others are unrolled inside each row
    from domain arrays (declared lists, or the distinct values: days are
    bounded by the calendar, labels by their code list). Nothing is shuffled
    until the counts are joined on.
    """
    return dense_grid(count_records(df, keys, name), keys, domains, name)


def dense_grid(counts: DataFrame, keys: Sequence[str], domains: Mapping[str, Sequence] | None = None, name: str = "admission_count") -> DataFrame:
    """The same from counts, of which there is one row per occurring combination."""
    domains = domains or {}
    first, *rest = keys
    cells = counts.select(first).distinct()
    for key in rest:
        values = F.array(*map(F.lit, domains[key])) if key in domains else distinct_values(counts, key)
        cells = cells.withColumn(key, F.explode(values))
    return cells.join(counts, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def daily_totals(
    df: DataFrame,
    key: str | Sequence[str] = "location",
    date: str = "date",
    count: str = "admission_count",
    severity: str = "disease_severity",
) -> DataFrame:
    """One row per series and day: summed count and mean severity. Rows without key or day are left out."""
    return df.na.drop(subset=[*as_list(key), date]).groupBy(*as_list(key), F.col(date).alias("ds")).agg(
        F.sum(count).alias("y"), F.avg(severity).alias("disease_severity")
    )


def daily_panel(
    df: DataFrame,
    population: Mapping[str, int] = POPULATION,
    default_population: int = DEFAULT_POPULATION,
    key: str = "location",
) -> DataFrame:
    """Daily totals with calendar parts and a rate per 100,000 persons.

    Calendar parts are recomputed from the day instead of carried through the
    aggregation, which keeps the shuffled rows narrow.
    """
    panel = daily_totals(df, key).withColumnRenamed("ds", "date").withColumnRenamed("y", "admission_count")
    day = F.col("date")
    panel = add(panel, {**calendar_parts(day), "is_weekend": is_weekend(day), "is_holiday": F.lit(0)})
    panel = panel.withColumn("population", lookup(F.col(key), population, default_population))
    return panel.withColumn("admissions_per_100k", per_100k(F.col("admission_count"), F.col("population")))


def per_100k(count: Column, population: Column) -> Column:
    return count / population * 100000


def with_next_observation(panel: DataFrame, key: str | Sequence[str], ds: str, y: str) -> DataFrame:
    """Each observed day with the gap to the next one, unrolled to one row per calendar day."""
    ahead = series_window(key, ds)
    observed = panel.withColumn("_next_y", F.lead(y).over(ahead)).withColumn(
        "_gap", F.coalesce(F.datediff(F.lead(ds).over(ahead), F.col(ds)), F.lit(1))
    )
    return observed.withColumn("_step", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_gap") - 1, F.lit(0)))))


def calendar_join(panel: DataFrame, key: str | Sequence[str] = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """All days between a series' first and last one; values are null on added days.

    Equal to a left join from a generated calendar, but each observed day
    unrolls the gap behind it, so there is no second shuffle and no join.
    """
    days = with_next_observation(panel, key, ds, y)
    others = [c for c in panel.columns if c not in {*as_list(key), ds}]
    kept = {c: F.when(F.col("_step") == 0, F.col(c)) for c in others}
    return add(days.withColumn(ds, F.date_add(ds, F.col("_step"))), kept).select(*panel.columns)


def fill_date_gaps(
    panel: DataFrame, key: str | Sequence[str] = "location", ds: str = "ds", y: str = "y", severity: str = "disease_severity"
) -> DataFrame:
    """Gap-free daily series: linear interpolation rounded half to even.

    Needs non-null values on the observed days (``keep_non_negative`` sees to
    it). One window over the observed days and a narrow unroll do the whole
    job: the next observation is at hand on every row that spawns a gap.
    """
    days = with_next_observation(panel, key, ds, y)
    start, step = F.col(y), F.col("_step")
    value = F.when(step == 0, start.cast("double")).otherwise(start + (F.col("_next_y") - start) * step / F.col("_gap"))
    day = F.date_add(ds, step)
    columns = [*as_list(key), day.alias("ds"), F.bround(value).cast("long").alias("y")]
    columns += [is_weekend(day).alias("is_weekend"), F.month(day).alias("month")]
    if severity in panel.columns:
        columns.append(F.col(severity))
    return days.select(*columns)


def capacity_table(
    admissions: DataFrame,
    beds: Mapping[str, tuple[int, int]] = BASE_BEDS,
    default: tuple[int, int] = DEFAULT_BEDS,
    noise: Column | None = None,
    location: str = "location",
    date: str = "date",
) -> DataFrame:
    """Beds per location and day, with reproducible availability noise.

    ``noise`` is a share in [-1, 1] per row, scaled to five percent of the
    beds; by default it is hashed from location and day.
    """
    cells = admissions.select(location).distinct()
    cells = cells.withColumn(date, F.explode(distinct_values(admissions, date)))
    if noise is None:
        noise = F.pmod(F.xxhash64(location, date), F.lit(2001)) / 1000 - 1
    total = lookup(F.col(location), {k: v[0] for k, v in beds.items()}, default[0])
    icu = lookup(F.col(location), {k: v[1] for k, v in beds.items()}, default[1])
    available = (F.col("total_beds") + F.col("total_beds") * BED_NOISE * noise).cast("int")
    return add(cells, {"total_beds": total, "icu_beds": icu}).withColumn("available_beds", F.greatest(F.lit(0), available))


def location_date_skeleton(df: DataFrame, location: str = "location", date: str = "date") -> DataFrame:
    """Every location on every observed day."""
    return df.select(location).distinct().withColumn(date, F.explode(distinct_values(df, date)))


def day_positions(df: DataFrame, ds: str = "ds") -> DataFrame:
    """(pos, ds): the days that occur, numbered from 0; the calendar bounds their number."""
    days = df.select(F.col(ds).alias("ds")).where("ds IS NOT NULL").distinct()
    return days.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ds")) - 1).alias("pos"), "ds")


def wide_by_day(df: DataFrame, ids: Sequence[str], value: str, days: DataFrame, ds: str = "ds") -> DataFrame:
    """One row per id with an array of sums, one place per day of ``days``, null where there is none.

    A wide table whose plan does not grow with the number of days. Every observed place
    unrolls the gap behind it, the first one also the gap before it.
    """
    size = days.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).scalar()
    placed = df.groupBy(*ids, F.col(ds).alias("ds")).agg(F.sum(value).alias("_v")).join(days, "ds").withColumn("_n", size)
    w = Window.partitionBy(*ids).orderBy("pos")
    low = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("pos"))
    high = F.coalesce(F.lead("pos").over(w), F.col("_n")) - 1
    spread = placed.withColumns({"_low": low, "_high": high}).withColumn("_p", F.explode(F.sequence("_low", "_high")))
    cell = F.struct("_p", F.when(F.col("_p") == F.col("pos"), F.col("_v")).alias("v"))
    return spread.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("values"))


def column_sums(wide: DataFrame, days: DataFrame, name: str) -> DataFrame:
    """Sum of every place of a wide table, by its day; a task sends one row per day at most."""
    cells = wide.select(F.posexplode("values").alias("pos", "_v"))
    sums = cells.groupBy("pos").agg(F.sum("_v").alias(name))
    return days.join(sums, "pos").select("ds", name)


def ratio_by_day(part: DataFrame, whole: DataFrame, part_name: str, whole_name: str, name: str) -> DataFrame:
    joined = whole.join(part, "ds")
    size = F.col(whole_name)
    return joined.withColumn(name, F.when(size > 0, F.col(part_name) / F.when(size > 0, size)))
