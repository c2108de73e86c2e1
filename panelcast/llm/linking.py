"""Classes of similar items from shared buckets, without all pairs of a bucket.

Items are put into buckets so that two similar items share one (prefix n-grams,
segments). Only classes of linked items are asked for, so two items that are
already in one class need no comparison. In the first round each item is
compared with the one bucket leader it meets most often. In the next ones, items
outside the largest class of a bucket are compared with a growing number of
leaders, which finds a link for nearly every member of a large group. At last
all pairs that still are in different classes and were never compared are
compared. Every pair that shares a bucket thus ends in one class or is verified,
once.

Ids are 64-bit hashes of the items, so the least id is a random member.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .store import drop, written

LEADERS = (1, 8, 64)
Check = Callable[[DataFrame], DataFrame]
Filter = Callable[[Column, Column], Column]


def shared_buckets(postings: DataFrame, label: str) -> DataFrame:
    """Postings (bucket, id, place, lead) of buckets that hold two items, one of them leading; written.

    One shuffle brings the buckets together, and the postings are made once. A bucket
    is judged by its least and greatest item, so most rows end there.
    """
    bucket = Window.partitionBy("bucket")
    ends = postings.withColumns({"low": F.min("id").over(bucket), "high": F.max("id").over(bucket), "led": F.max("lead").over(bucket)})
    kept = ends.where((F.col("low") != F.col("high")) & F.col("led"))
    return written(kept.drop("low", "high", "led").distinct(), label)


def link_classes(postings: DataFrame, verify: Check, could_link: Filter, loosely: Filter | None = None) -> DataFrame:
    """(id, label) for all items with a link; the label is the least id of the class.

    ``postings`` come from ``shared_buckets``. ``could_link`` takes the places of
    two items in a bucket and says whether they may be similar by what this bucket
    tells, ``loosely`` whether by what any bucket tells; ``verify`` takes
    pairs (a, b) and returns those that are. What it writes on the way is dropped
    once nothing reads it, so the disk holds one round.
    """
    tested, labels = None, None
    for step in range(len(LEADERS) + 1):
        rows = _labelled(postings, labels)
        if step == 0:
            pairs = _star(rows, could_link)
        elif step < len(LEADERS):
            pairs = _loose(rows, step, LEADERS[step], loosely or could_link)
        else:
            pairs = _rest(rows, could_link)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            drop(pairs)
            continue
        found = written(verify(pairs), "links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        # a class so far is a star around its label, so links of earlier rounds aren't needed any more
        edges = found if labels is None else found.unionAll(labels.where("id != label").select(F.col("label").alias("a"), F.col("id").alias("b")))
        before, labels = labels, components(edges)
        drop(found)
        if before is not None:
            drop(before)
    if tested is not None:
        drop(tested)
    if labels is None:
        return postings.sparkSession.createDataFrame([], "id long, label long")
    return labels


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("id"))
    return postings.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _star(rows: DataFrame, could_link: Filter) -> DataFrame:
    """Each item with the leader it shares most buckets with."""
    item = F.struct("id", "place")
    leaders = rows.groupBy("bucket").agg(F.min(F.when(F.col("lead"), item)).alias("leader"))
    met = rows.join(leaders, "bucket").where((F.col("id") != F.col("leader.id")) & could_link(F.col("place"), F.col("leader.place")))
    votes = met.groupBy("id", F.col("leader.id").alias("other")).agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", "other")).alias("best"))
    return _ordered(best.select("id", F.col("best.other").alias("other")))


def _loose(rows: DataFrame, step: int, fan: int, could_link: Filter) -> DataFrame:
    """Items outside the largest class of a bucket, with up to ``fan`` members of their fullest such bucket."""
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("classes")).where("classes > 1")
    loose = rows.join(mains, "bucket").where(F.col("label") != F.col("main.label"))
    chosen = loose.groupBy("id", "label").agg(F.max(F.struct("members", "bucket", "place")).alias("best")).select("id", "label", "best.bucket", "best.place")
    slot = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(fan)).alias("slot")
    item = F.struct(F.xxhash64("id", F.lit(-step)).alias("order"), "id", "label", "place")
    met = rows.where("lead").join(chosen.select("bucket").distinct(), "bucket", "left_semi")
    leaders = met.groupBy("bucket", slot).agg(F.min(item).alias("leader")).select("bucket", F.col("leader.id").alias("other"), F.col("leader.label").alias("other_label"), F.col("leader.place").alias("other_place"))
    differ = (F.col("label") != F.col("other_label")) & could_link(F.col("place"), F.col("other_place"))
    return _ordered(chosen.join(leaders, "bucket").where(differ))


def _rest(rows: DataFrame, could_link: Filter) -> DataFrame:
    """All pairs of a bucket that are in different classes, one of them leading."""
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    left = rows.join(mixed.select("bucket"), "bucket", "left_semi")
    right = left.where("lead").select("bucket", F.col("id").alias("other"), F.col("place").alias("other_place"), F.col("label").alias("other_label"))
    differ = (F.col("label") != F.col("other_label")) & could_link(F.col("place"), F.col("other_place"))
    return _ordered(left.join(right, "bucket").where(differ))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the connected components of edges (a, b), label the least id.

    Alternates hooking larger and smaller neighbours to the least one of each
    item (large and small stars) until the edges stay as they are; each pass is
    written, so the lineage stays short.
    """
    now, mark = _marked(_ordered(edges.select(F.col("a").alias("id"), F.col("b").alias("other"))).where("a != b"))
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        large = _hook(both, F.col("v") > F.col("u"))
        small = _hook(large.select(F.col("b").alias("u"), F.col("a").alias("v")), F.lit(True), closing=True)
        last = now
        now, seen = _marked(small)
        drop(last)
        if seen == mark:
            # written, since each round reads it twice; files of known size are broadcast if they are small
            labels = written(now.select(F.col("b").alias("id"), F.col("a").alias("label")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("label"))).distinct(), "labels")
            drop(now)
            return labels
        mark = seen


def _hook(rows: DataFrame, wanted: Column, closing: bool = False) -> DataFrame:
    """Joins the neighbours v of each u to the least of u and its neighbours; pairs (a < b)."""
    least = rows.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    hooked = rows.where(wanted).join(least, "u").select(F.col("least").alias("a"), F.col("v").alias("b"))
    if closing:
        hooked = hooked.unionAll(least.select(F.col("least").alias("a"), F.col("u").alias("b")))
    return hooked.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and an order-free hash: equal for equal edges."""
    seen = Observation()
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    table = written(edges.observe(seen, F.count("*").alias("n"), F.sum(hashed).alias("hash")), "edges")
    return table, (seen.get["n"], seen.get["hash"])
