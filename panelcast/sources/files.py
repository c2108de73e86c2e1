"""Readers and writers for series, forecasts, metrics and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import slug, unslug


def workspace(spark: SparkSession, label: str) -> str:
    """Fresh folder in storage the session names: its checkpoint folder, else its warehouse.

    Both are shared by all executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/panelcast/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing the table to shared storage and reading it back."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names. Lists and reads nothing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_series(spark: SparkSession, path: str, schema: StructType | str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Series file with its day parsed; a missing file gives an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("dateFormat", date_format).csv(path, header=True)
    return df.withColumn("ds", F.to_date("ds"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """First path that is there, else the first one named."""
    return next((p for p in paths if exists(spark, p)), paths[0])


def read_forecast_folder(spark: SparkSession, folder: str, schema: StructType | str, prefix: str = "forecast_", suffix: str = ".csv") -> DataFrame:
    """All per-series forecast files of a folder; the series name comes from the file name.

    Works for ``<prefix>new_york<suffix>`` files and folders alike.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(folder, header=True)
    path = F.regexp_extract(F.col("_metadata.file_path"), f"({prefix}[^/]*{suffix})", 1)
    return df.withColumn("location", unslug(path, prefix, suffix))


def write_metrics(df: DataFrame, path: str, metrics: Sequence[str], key: str = "location", documents: int = 1) -> None:
    """Saves ``{key: {metric: value}}`` as one JSON document, or cut into several by a hash of the key.

    A document is one row, so more series than a row can hold need more documents;
    the reader takes any number of them.
    """
    values = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    rows = df.select(F.col(key).cast("string").alias("_key"), values.alias("_values")).where("_key IS NOT NULL")
    part = F.pmod(F.xxhash64("_key"), F.lit(documents)).alias("_part")
    grouped = rows.groupBy(part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", F.map_entries("_values").alias("_v"))))).alias("_doc"))
    document = F.transform_values("_doc", lambda k, v: F.map_from_entries(v))
    # a file holds one document
    grouped.select("_part", F.to_json(document, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("_part").text(path)


def read_metrics(spark: SparkSession, path: str, key: str = "location") -> DataFrame:
    """Documents ``{key: {metric: value}}``, on one line or many, as rows (key, metric, value)."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias(key, "_values"))
    return parsed.select(key, F.explode("_values").alias("metric", "value"))


def _id_fields(count: int) -> str:
    """Pattern of the first fields of a line, each with its comma; quoted ones may hold commas."""
    return '((?:(?:"(?:[^"]|"")*"|[^,"]*),){' + str(count) + "})"


def write_wide(wide: DataFrame, days: DataFrame, path: str, ids: Sequence[str]) -> None:
    """Table (ids, values) as text with a column per day; ``days`` (pos, ds) names the columns.

    Lines are put together here, so there is one text column, whose name is the header.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", F.date_format("ds", "yyyy-MM-dd").alias("ds"))))
    header = days.agg(F.array_join(F.transform(listed, lambda d: d["ds"]), ",")).first()[0]  # one line, bounded by the calendar
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(i).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for i in ids]
    cells = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit(""))), ",")
    line = F.concat_ws(",", *quoted, cells).alias(",".join([*ids, header]))
    wide.select(line).write.mode("overwrite").options(header=True, sep="\x01", quote="\x00", escapeQuotes=False).csv(path)


def read_wide(spark: SparkSession, paths: Sequence[str], ids: Sequence[str], kind: str = "long") -> tuple[DataFrame, DataFrame]:
    """Rows (ids, values) and days (pos, ds) of a table with a column per day, from the first of several paths that is there.

    Lines are read as text and split into arrays; the header gives the day of each
    place, so neither schema nor plan knows the number of days.
    """
    lines = spark.read.text(first_existing(spark, *paths))
    lead = ",".join(ids) + ","
    is_header = F.col("value").startswith(lead)
    header = lines.where(is_header).limit(1).select(F.posexplode(F.split(F.substring("value", len(lead) + 1, 1 << 30), ",")).alias("pos", "_day"))
    days = header.select("pos", F.to_date("_day").alias("ds"))
    start = F.regexp_extract("value", "^" + _id_fields(len(ids)), 1)
    rows = lines.where(~is_header & (F.trim("value") != "")).select(start.alias("_ids"), "value")
    rest = F.split(F.expr("substr(value, char_length(_ids) + 1)"), ",")

    def field(number: int) -> Column:
        raw = F.regexp_extract("_ids", "^" + _id_fields(number) + '("(?:[^"]|"")*"|[^,"]*),', 2)
        inner = F.replace(F.regexp_extract(raw, '^"(.*)"$', 1), F.lit('""'), F.lit('"'))
        return F.when(raw.startswith('"'), inner).otherwise(raw)

    values = F.transform(rest, lambda v: v.try_cast(kind)).alias("values")
    return rows.select(*[field(n).alias(i) for n, i in enumerate(ids)], values), days


def read_partition(spark: SparkSession, path: str, **values: str) -> DataFrame:
    """Rows of some partitions of a saved table; only their folders are listed."""
    df = spark.read.parquet(path)
    for name, value in values.items():
        df = df.filter(F.col(name) == value)
    return df


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_by(df: DataFrame, path: str, *partitions: str) -> None:
    """One folder per partition value, all written by one job.

    Rebalancing brings the rows of a value together, so each folder holds few
    files, and adaptive execution splits a hot value over several tasks.
    """
    df.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_slugged(df: DataFrame, folder: str, name: str = "location", prefix: str = "forecast_", suffix: str = ".csv") -> None:
    """Text files per series, foldered by the slug of the series name."""
    file = F.concat(F.lit(prefix), slug(F.col(name)), F.lit(suffix))
    df.withColumn("file", file).drop(name).hint("rebalance", "file").write.mode("overwrite").partitionBy("file").csv(folder, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pair(detailed: DataFrame, summary: DataFrame, folder: str) -> None:
    """Saves dated predictions and their summary so that they are seen together or not at all.

    Both go to folders of their own; one row of the manifest, appended last, makes them
    the current pair. A writer lost before that leaves the pair before.
    """
    spark = detailed.sparkSession
    version = max((row["version"] for row in _manifest(spark, folder)), default=0) + 1
    token = uuid.uuid4().hex
    paths = {"detailed": f"{folder}/detailed-{token}", "summary": f"{folder}/summary-{token}"}
    detailed.write.parquet(paths["detailed"])
    summary.write.json(paths["summary"])
    entry = spark.createDataFrame([(version, paths["detailed"], paths["summary"], summary.schema.json())], MANIFEST)
    entry.coalesce(1).write.mode("append").json(f"{folder}/manifest")


MANIFEST = "version long, detailed string, summary string, summary_schema string"


def _manifest(spark: SparkSession, folder: str) -> list:
    """One row per committed pair."""
    path = f"{folder}/manifest"
    return spark.read.schema(MANIFEST).json(path).collect() if exists(spark, path) else []


def read_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The current pair (detailed, summary)."""
    latest = max(_manifest(spark, folder), key=lambda row: row["version"])
    fields = StructType.fromJson(json.loads(latest["summary_schema"]))
    return spark.read.parquet(latest["detailed"]), spark.read.schema(fields).json(latest["summary"])
