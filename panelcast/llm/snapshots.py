"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

Texts are equal if they are the same bytes after the blanks are deleted. A batch of
documents is committed in these steps:

* its own duplicates are grouped by digest and text, copies merging in every task
  before anything is shuffled;
* the digests of its distinct texts are screened by the filters of each earlier
  snapshot, which are cut by ranges of the digest so that a filter never holds more
  than a bounded number of keys, however large a snapshot is;
* what a filter lets through is joined with the snapshot's texts in the exact bucket
  of its digest and compared byte by byte; equal texts belong to the class that began
  there, a digest or filter hit with other bytes does not;
* the rest are new texts; the batch becomes a snapshot with a filter of their digests.

Nothing that was committed is changed. A commit writes below its own number and reads
only lower ones: repeated under its number after a lost run it writes the same again,
which has to happen before the next one. Classes add up the snapshots' counts.

Of a class the row with the most code points in the original text stays, then the
smallest doc_id; null ids count as the largest. Of rows equal in both, one stays.
Null texts are empty, and all blank texts are equal; an empty table gives no rows and
an empty snapshot; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fusefilter
from .store import written

BLANKS = " \t\n\x0b\f\r"
SHARD_KEYS = 1 << 18
MAX_BITS = 16
Digest = Callable[[Column], Column]
FILTER = "shard int, seed int, length int, segments long, prints binary"
TABLES = {
    "texts": "digest binary, text string, size long, best decimal(38,0), id long",
    "known": "id long, home int, home_id long",
    "filters": f"{FILTER}, bits int",
}


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rank_of(n_points: Column, doc_id: Column) -> Column:
    """One number per row: more code points first, then the smaller id, null the largest."""
    wide = "decimal(38,0)"
    later = F.coalesce(F.lit(2**63 - 1).cast(wide) - doc_id.cast(wide) + F.lit(1), F.lit(0).cast(wide))
    return (n_points.cast("decimal(12,0)") * F.lit(Decimal(2**65)).cast("decimal(20,0)") + later).cast(wide)


def documents(docs: DataFrame, digest: Digest) -> DataFrame:
    """Id, digest, rank and normal text of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = own.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), normal(F.col("text")).alias("text"))
    return found.select("doc_id", digest(F.col("text")).alias("digest"), rank_of(F.col("n_points"), F.col("doc_id")).alias("rank"), "text")


def _part(ledger: str, number: int, name: str) -> str:
    return f"{ledger}/snapshot_{number}/{name}"


def _read(spark: SparkSession, ledger: str, number: int, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(_part(ledger, number, name))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def snapshot_texts(spark: SparkSession, ledger: str, number: int) -> DataFrame:
    """The texts that a snapshot was the first to hold."""
    return _read(spark, ledger, number, "texts").join(_read(spark, ledger, number, "known").select("id"), "id", "left_anti")


def commit(docs: DataFrame, ledger: str, number: int, digest: Digest = sha256) -> None:
    """Adds the documents as snapshot ``number``, counted from 0."""
    spark = docs.sparkSession
    grouped = documents(docs, digest).groupBy("digest", "text").agg(F.count("*").alias("size"), F.max("rank").alias("best"))
    place = _part(ledger, number, "texts")
    grouped.withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(place)
    batch = _read(spark, ledger, number, "texts")
    n = batch.count()
    known = _known(batch, n, ledger, number) if number else spark.createDataFrame([], TABLES["known"])
    known.write.mode("overwrite").parquet(_part(ledger, number, "known"))
    bits = max(0, min(MAX_BITS, (max(n, 1) // SHARD_KEYS).bit_length()))
    fresh = snapshot_texts(spark, ledger, number).select("digest", _shard(bits).alias("shard"))
    built = fresh.groupBy("shard").applyInArrow(_build, FILTER).withColumn("bits", F.lit(bits))
    built.write.mode("overwrite").parquet(_part(ledger, number, "filters"))


def _shard(bits: int) -> Column:
    """The range of its first two bytes that a digest is in, as a number of ``bits`` bits."""
    lead = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    return F.shiftright(lead, MAX_BITS - bits)


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    data = b"".join(d[:8] for d in digests.to_pylist())
    return np.frombuffer(data, ">u8").astype(np.uint64)


def _build(rows: pa.Table) -> pa.Table:
    f = fusefilter.build(_keys(rows.column("digest")))
    row = {"shard": rows.column("shard")[0].as_py(), **f}
    return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("seed", pa.int32()), ("length", pa.int32()), ("segments", pa.int64()), ("prints", pa.binary())]))


def _screen(rows: pa.Table, filters: pa.Table) -> pa.Table:
    """Rows that the filter of their snapshot and range lets through."""
    out = rows.select(["id", "home"])
    if not len(filters) or not len(rows):
        return out.slice(0, 0)
    return out.filter(pa.array(fusefilter.contains(filters.to_pylist()[0], _keys(rows.column("digest")))))


def _known(batch: DataFrame, n: int, ledger: str, number: int) -> DataFrame:
    """(id, home, home_id) of the batch's texts that a snapshot below ``number`` was the first to hold."""
    spark = batch.sparkSession
    filters = _union([_read(spark, ledger, i, "filters").withColumn("home", F.lit(i)) for i in range(number)])
    bits = {r["home"]: r["bits"] for r in filters.groupBy("home").agg(F.max("bits").alias("bits")).collect()}  # a row per snapshot
    if not bits:
        return spark.createDataFrame([], TABLES["known"])
    # a batch far larger than a snapshot meets copies of its filters, each with a bounded part
    parts = {home: 1 + n // (SHARD_KEYS << b) for home, b in bits.items()}
    ways = [F.struct(F.lit(home).alias("home"), _shard(b).alias("shard"), F.pmod("id", F.lit(parts[home])).alias("part")) for home, b in bits.items()]
    asked = batch.select("id", "digest", F.inline(F.array(*ways)))
    last = F.element_at(F.create_map(*[F.lit(x) for home, p in parts.items() for x in (home, p - 1)]), F.col("home"))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), last).cast("array<long>")))
    key = ["home", "shard", "part"]
    passed = asked.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_screen, "id long, home int")
    mine = batch.select("id", "digest", "text").join(passed, "id")
    held = [snapshot_texts(spark, ledger, i).select("digest", F.lit(i).alias("home"), F.col("text").alias("held"), F.col("id").alias("home_id")) for i in range(number)]
    same = mine.join(_union(held), ["home", "digest"]).where(F.col("text") == F.col("held"))
    return same.select("id", "home", "home_id")


def classes(spark: SparkSession, ledger: str, count: int) -> DataFrame:
    """(home, home_id, digest, size, best) of all distinct texts of the first ``count`` snapshots."""
    members = []
    for number in range(count):
        texts = _read(spark, ledger, number, "texts").select("id", "digest", "size", "best")
        found = texts.join(_read(spark, ledger, number, "known"), "id", "left")
        members.append(found.select(F.coalesce("home", F.lit(number)).alias("home"), F.coalesce("home_id", "id").alias("home_id"), "digest", "size", "best"))
    return _union(members).groupBy("home", "home_id", "digest").agg(F.sum("size").alias("size"), F.max("best").alias("best"))


def by_document(docs: DataFrame, ledger: str, count: int, digest: Digest = sha256) -> DataFrame:
    """Every row of the committed documents: doc_id, keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    found = written(classes(spark, ledger, count), "classes")
    rows = documents(docs, digest)
    # written, so that the join can split a digest that holds a large share of the rows
    slim = written(rows.drop("text").withColumn("uid", F.monotonically_increasing_id()), "rows")
    shared = written(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared")
    if shared.isEmpty():
        joined = slim.join(found, "digest")
    else:
        # different texts under one digest: their rows find their class by the bytes
        whole = written(rows.join(shared, "digest", "left_semi").withColumn("uid", F.monotonically_increasing_id() + F.lit(1 << 62)), "shared-rows")
        apart = found.join(shared, "digest", "left_semi")
        texts = _union([snapshot_texts(spark, ledger, i).select(F.lit(i).alias("home"), F.col("id").alias("home_id"), F.col("text").alias("held")) for i in range(count)])
        by_bytes = whole.join(apart.join(texts, ["home", "home_id"]), "digest").where(F.col("text") == F.col("held")).drop("text", "held")
        joined = slim.join(found.join(shared, "digest", "left_anti"), "digest").unionByName(by_bytes)
    joined = written(joined, "joined")
    # of rows that are equal in length and id, the first one stays
    stays = joined.where(F.col("rank") == F.col("best")).groupBy("home", "home_id").agg(F.min("uid").alias("uid"))
    marked = joined.join(stays.select("uid", F.lit(True).alias("kept")), "uid", "left")
    later = F.pmod("best", F.lit(Decimal(2**65)).cast("decimal(38,0)"))
    keep = F.when(later > 0, (F.lit(Decimal(2**63)).cast("decimal(38,0)") - later).cast("long"))
    return marked.select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), F.coalesce("kept", F.lit(False)).alias("kept"), "digest")
