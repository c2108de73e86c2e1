"""Token counts as rollups that are maintained by deltas.

An event inserts, deletes or revises the count of one document under one
tokenizer version. It carries the image before and the image after (source,
language, tokens; null where there is none), so each event is one or two signed
rows, and totals are sums of signed rows in any order. A batch is reduced per
(source, lang, tokenizer) and written to a folder of its own number; writing it
again replaces the same folder, so a batch counts once however often it is
committed. Totals add up the committed batches.

Rows: null sources, languages and tokenizers are groups of their own; null
tokens count as none; an event delivered twice in a batch counts once, by
event_id; an empty batch adds nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import exists

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def image(source: Column, lang: Column, tokens: Column) -> Column:
    return F.struct(source.alias("source"), lang.alias("lang"), tokens.cast("long").alias("tokens"))


def signed(events: DataFrame) -> DataFrame:
    """Events (event_id, tokenizer, before, after) as signed rows."""

    def side(name: str, sign: int) -> Column:
        x = F.col(name)
        return F.when(x.isNotNull(), F.struct(x["source"].alias("source"), x["lang"].alias("lang"), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(x["tokens"], F.lit(0))).alias("tokens")))

    both = F.array_compact(F.array(side("before", -1), side("after", 1)))
    return events.select("tokenizer", F.inline(both))


def delta(events: DataFrame, unique: bool = False) -> DataFrame:
    """Additive change of a batch per group; groups whose sums cancel out are left out."""
    once = events if unique else events.dropDuplicates(["event_id"])
    sums = signed(once).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def commit(events: DataFrame, store: str, batch: int, unique: bool = False) -> None:
    """Writes the batch's change; ``unique`` says that no event can come twice."""
    delta(events, unique).write.mode("overwrite").parquet(f"{store}/batch_{batch}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Current documents and tokens per group."""
    if not exists(spark, store):
        return spark.createDataFrame([], DELTA)
    rows = spark.read.schema(DELTA).option("recursiveFileLookup", "true").parquet(store)
    sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Writes the totals of all batches as the first batch of a new store."""
    totals(spark, store).write.mode("overwrite").parquet(f"{target}/batch_0")
