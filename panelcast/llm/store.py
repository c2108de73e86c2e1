"""Tables, scratch storage and word patterns that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import workspace

#: Words are runs of anything but a space and the ASCII control blanks.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """The table after it was written to shared storage: later jobs read files, not lineage."""
    path = workspace(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more; other files are left alone."""
    for df in tables:
        context = df.sparkSession.sparkContext
        root = workspace(df.sparkSession, "").rpartition("/")[0]
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if f"{root.split(':', 1)[-1].lstrip('/')}/" in folder:
                place = context._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def words(text: Column) -> Column:
    """Array of words, empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
