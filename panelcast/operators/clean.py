"""Cleaning, binning and classification of raw records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from .keys import row_index

# Age bin edges and labels.
AGE_EDGES = (0, 18, 30, 50, 65, 120)
AGE_LABELS = ("0-18", "19-30", "31-50", "51-65", "65+")

# Severity per condition, 1 for anything else.
SEVERITY = {
    "COVID-19": 3,
    "Pneumonia": 3,
    "Heart Disease": 3,
    "Flu": 2,
    "Diabetes": 2,
    "Others": 1,
    "Unknown": 1,
}

# Flag-column token to condition, first match wins.
CONDITIONS = {
    "CAD": "Heart Disease",
    "STEMI": "Heart Disease",
    "ACS": "Heart Disease",
    "HTN": "Heart Disease",
    "CMP": "Heart Disease",
    "CHB": "Heart Disease",
    "AF": "Heart Disease",
    "VT": "Heart Disease",
    "PSVT": "Heart Disease",
    "WPWS": "Heart Disease",
    "CHF": "Heart Disease",
    "DM": "Diabetes",
    "CKD": "Kidney Disease",
    "UTI": "Infection",
    "INFECTIVE ENDOCARDITIS": "Infection",
    "DVT": "Blood Clot",
    "CVA": "Stroke",
    "NEURO": "Neurological",
}
DEFAULT_CONDITION = "Heart Disease"

# Places and their percentage shares for hashed assignment, and
# the candidates for rural and urban records.
PLACES = ("Ludhiana Central", "Ludhiana South", "Ludhiana North", "Punjab Rural", "Punjab Urban")
PLACE_SHARES = (40, 20, 15, 15, 10)
RURAL_PLACES = ("Punjab Rural", "Ludhiana North")
URBAN_PLACES = ("Ludhiana Central", "Ludhiana South", "Punjab Urban")
RURAL_WORDS = ("1", "YES", "Y", "RURAL")

# Accepted names of the date and age columns, in order, and the
# first day of the stand-in calendar.
DATE_NAMES = ("D.O.A", "DOA", "Date of Admission", "date")
DATE_HINTS = ("date", "d.o.a")
AGE_NAMES = ("AGE", "Age", "age")
DEFAULT_AGE = 35.0
INDEX_START = "2017-04-01"


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_non_negative(df: DataFrame, count: str = "admission_count") -> DataFrame:
    """Null counts fail the comparison and go as well."""
    return df.filter(F.col(count) >= 0)


def outlier_filter(df: DataFrame, value: str = "admission_count", deviations: float = 5) -> DataFrame:
    """Keep values within so many sample deviations of the mean.

    Mean and deviation come from a one-row scalar subquery, so the filter
    itself stays a narrow operation.
    """
    stats = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))).scalar()
    return df.filter(F.abs(F.col(value) - stats["mean"]) <= deviations * stats["std"])


def fill_unknown(df: DataFrame, columns: Sequence[str] = ("disease_type", "age_group")) -> DataFrame:
    return df.fillna({c: "Unknown" for c in columns})


def reject_future(df: DataFrame, date: str = "date", today: Column | None = None) -> DataFrame:
    return df.filter(F.col(date) <= (F.current_date() if today is None else today))


def clean(df: DataFrame, count: str = "admission_count", date: str = "date", today: Column | None = None) -> DataFrame:
    """All cleaning steps in their fixed order; the outlier bounds see deduplicated rows."""
    kept = keep_non_negative(drop_duplicate_rows(df), count)
    return reject_future(fill_unknown(outlier_filter(kept, count)), date, today)


def removal_audit(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: rows before and after cleaning, and a warning below half."""
    before = raw.agg(F.count("*").alias("initial_rows"))
    after = cleaned.agg(F.count("*")).scalar()
    share = F.col("final_rows") / F.col("initial_rows")
    return (
        before.withColumn("final_rows", after)
        .withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))
        .withColumn("kept_share", F.when(F.col("initial_rows") > 0, share))
        .withColumn("half_removed", F.coalesce(F.col("kept_share") < 0.5, F.lit(False)))
    )


def find_date_column(columns: Sequence[str]) -> str | None:
    for name in DATE_NAMES:
        if name in columns:
            return name
    return next((c for c in columns if any(hint in c.lower() for hint in DATE_HINTS)), None)


def parse_record_dates(df: DataFrame, fmt: str = "d/M/yyyy", order: str | None = None) -> DataFrame:
    """Add ``parsed_date`` from the date column, or a daily index if there is none.

    The index needs ``order``, a unique column fixing the row order.
    """
    source = find_date_column(df.columns)
    if source is not None:
        column = F.col(f"`{source}`")
        typed = dict(df.dtypes)[source]
        parsed = text.lenient_date(column, fmt) if typed == "string" else F.to_date(column)
        return df.withColumn("parsed_date", parsed)
    if order is None:
        raise ValueError("no date column found; pass order= to number the rows")
    start = F.lit(INDEX_START).cast("date")
    return row_index(df, order, "_n").withColumn("parsed_date", F.date_add(start, F.col("_n").cast("int"))).drop("_n")


def parse_age(df: DataFrame) -> DataFrame:
    source = next((name for name in AGE_NAMES if name in df.columns), None)
    age = F.lit(DEFAULT_AGE) if source is None else text.lenient_number(F.col(source), DEFAULT_AGE)
    return df.withColumn("age_numeric", age)


def bin_half_open(value: Column, edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS) -> Column:
    """Label of the bin ``[low, high)`` holding the value; null outside all bins."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges[:-1], edges[1:], labels))):
        label = F.when((value >= low) & (value < high), name).otherwise(label)
    return label


def bin_right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(low, high]`` holding the value; null outside all bins."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges[:-1], edges[1:], labels))):
        label = F.when((value > low) & (value <= high), name).otherwise(label)
    return label


def _matches(key: str, name: str, substring: bool) -> bool:
    if substring:
        return key in name
    words = "".join(ch if ch.isalnum() else " " for ch in name).split()
    wanted = key.split()
    return any(words[i : i + len(wanted)] == wanted for i in range(len(words)))


def classify_flags(
    df: DataFrame,
    mapping: Mapping[str, str] = CONDITIONS,
    default: str = DEFAULT_CONDITION,
    substring: bool = False,
) -> Column:
    """Condition named by the first set flag, in column order.

    Which column stands for which condition is settled from the column names
    while the plan is built, so a row costs one coalesce over the flags that
    matter. Names match on whole words unless ``substring`` is asked for.
    Rows without a set flag fall back to a search in the free-text columns.
    """
    choices = []
    for name in df.columns:
        label = next((v for k, v in mapping.items() if _matches(k, name.upper(), substring)), None)
        if label is not None:
            choices.append(F.when(text.is_set(F.col(f"`{name}`")), label))
    for name in df.columns:
        if "DIAGNOSIS" in name.upper() or "TYPE" in name.upper():
            content = F.upper(F.col(f"`{name}`").cast("string"))
            for key, label in mapping.items():
                choices.append(F.when(content.contains(key), label))
    return F.coalesce(*choices, F.lit(default))


def assign_weighted(bucket: Column, places: Sequence[str] = PLACES, shares: Sequence[int] = PLACE_SHARES) -> Column:
    """Place for a bucket in 0..99 by cumulative percentage shares."""
    place, limit = F.lit(places[-1]), 100
    for name, share in reversed(list(zip(places, shares))):
        limit -= share
        place = place if limit + share >= 100 else F.when(bucket < limit + share, name).otherwise(place)
    return place


def assign_rural_urban(rural: Column, bucket: Column) -> Column:
    """Even split inside the rural and the urban places; all places when unknown."""

    def pick(names: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (bucket % len(names) + 1).cast("int"))

    is_rural = F.upper(rural.cast("string")).isin(*RURAL_WORDS)
    return F.when(rural.isNull(), pick(PLACES)).when(is_rural, pick(RURAL_PLACES)).otherwise(pick(URBAN_PLACES))


def hash_bucket(*key: str) -> Column:
    """Reproducible stand-in for a random draw from 0..99."""
    return F.pmod(F.xxhash64(*key), F.lit(100))


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def to_admission_records(
    df: DataFrame,
    row_key: str,
    mapping: Mapping[str, str] = CONDITIONS,
    default: str = DEFAULT_CONDITION,
    fmt: str = "d/M/yyyy",
) -> DataFrame:
    """Raw wide records to (date, location, disease_type, age_group), one row each."""
    rural = next((c for c in df.columns if "RURAL" in c.upper()), None)
    bucket = hash_bucket(row_key)
    place = assign_weighted(bucket) if rural is None else assign_rural_urban(F.col(f"`{rural}`"), bucket)
    condition = classify_flags(df, mapping, default)
    parsed = parse_age(parse_record_dates(df, fmt, row_key))
    return drop_incomplete(
        parsed.select(
            F.col("parsed_date").alias("date"),
            place.alias("location"),
            condition.alias("disease_type"),
            bin_half_open(F.col("age_numeric")).alias("age_group"),
        ),
        ["date", "age_group"],
    )
