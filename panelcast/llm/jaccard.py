"""Jaccard join of documents on word n-grams: rare-first prefix filtering.

A document is the set of its distinct n-grams, kept as 64-bit hashes; with
fewer words the whole sequence is one, without words the set is empty and joins
nothing. Tokens are ordered by frequency, rarest first. Two sets that overlap
enough share a token among the first |x| - ceil(t|x|) + 1 of each (prefix
filter), differ little in size (length filter), leave enough tokens behind the
shared one (positional filter) and hold similar numbers of tokens in every part
that fixed pivots cut the token space into (suffix filter). What passes is
verified once per pair by intersecting the sets.

Frequencies come from all documents: each task counts tokens in a table of
fixed size, the tables are summed per cell range, and one byte per cell
(logarithm of the count) is sent to the tasks. Any order of tokens gives the
same result, so that cells are shared costs speed alone.

Equal sets count as one item. Rows: null texts have the empty set; equal
doc_ids are separate rows of one class; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .backoff import word_lists
from .linking import link_classes, shared_buckets
from .store import drop, written
from .tokenizing import text_batches

CELL_BITS, RANGE_BITS = 22, 6
BATCH_CHARS = 6_000_000
# Counts kept per set: the more, the larger are the sets that counts alone tell apart.
PARTS = 64


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    h = hashes ^ (hashes >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text.

    Each distinct word is hashed once; the hashes of all n-grams are mixed from
    them over the whole array, then cut at the texts' ends.
    """
    words, counts = word_lists(texts)
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = own[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    grams = _mix(hashes, n)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= n:
            out.append(np.unique(grams[end - count : end - n + 1]))
        else:
            out.append(_mix(hashes[end - count : end], count) if count else hashes[:0])
    return out


def _mix(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words."""
    runs = max(0, len(hashes) - width + 1)
    gram = np.full(runs, width, np.uint64)
    for i in range(width):
        gram = mixed(gram + hashes[i : runs + i])
    return gram


def frequency_cells(docs: DataFrame, n: int) -> np.ndarray:
    """One byte per cell: the logarithm of how many tokens of all documents fall into it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in text_batches(batches, chars=BATCH_CHARS):
            cells += np.bincount(cell_of(np.concatenate(shingles(batch.column("text"), n))), minlength=len(cells))
        width = len(cells) >> RANGE_BITS
        for i in range(1 << RANGE_BITS):
            part = cells[i * width : (i + 1) * width]
            packed = part.astype(np.uint8 if part.max(initial=0) < 256 else np.uint16 if part.max(initial=0) < 65_536 else np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed.itemsize], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["cells", "bytes", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << CELL_BITS) >> RANGE_BITS, np.int64)
        for batch in batches:
            for size, counts in zip(batch.column("bytes").to_pylist(), batch.column("counts").to_pylist()):
                total += np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 8: np.int64}[size])
        logs = np.ceil(np.log2(np.maximum(total, 1)) * 3).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([logs.tobytes()], pa.binary())], ["cells", "logs"])

    counted = docs.select("text").mapInArrow(count, "cells int, bytes int, counts binary")
    summed = counted.groupBy("cells").applyInArrow(add, "cells int, logs binary")
    rows = sorted(summed.collect())  # 2**RANGE_BITS rows, one byte per cell
    return np.frombuffer(b"".join(bytes(r["logs"]) for r in rows), np.uint8) if rows else np.zeros(1 << CELL_BITS, np.uint8)


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def prefixes(docs: DataFrame, n: int, percent: int, cells: np.ndarray) -> DataFrame:
    """Rows of two kinds: a document with its set (bucket null), and prefix tokens of sets new to the task."""
    logs = docs.sparkSession.sparkContext.broadcast(cells)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_batches(batches, chars=BATCH_CHARS):
            ids = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {k: [] for k in ("doc", "set", "size", "parts")}
            buckets, owners, places = [], [], []
            for doc, tokens in zip(ids, shingles(batch.column("text"), n)):
                size = len(tokens)
                own = set_id(tokens) if size else None
                out["doc"].append(doc)
                out["set"].append(own)
                out["size"].append(size)
                fresh = size > 0 and own not in seen
                out["parts"].append(np.bincount((tokens & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32) if fresh else None)
                if not fresh:
                    continue
                seen.add(own)
                length = size - -(-percent * size // 100) + 1
                rank = logs.value[cell_of(tokens)]
                if length < size:
                    # the rarest tokens; ties by hash, so the order is one for all sets
                    bar = np.partition(rank, length - 1)[length - 1]
                    tokens = np.concatenate((tokens[rank < bar], tokens[rank == bar][: length - int((rank < bar).sum())]))
                order = np.lexsort((tokens, logs.value[cell_of(tokens)]))
                buckets.append(tokens[order].view(np.int64))
                owners.append(np.full(len(tokens), own))
                places.append(np.arange(len(tokens), dtype=np.int64) + (size << 32))
            n_docs = len(ids)
            heads = [pa.nulls(n_docs, pa.int64()), pa.array(out["set"], pa.int64()), pa.array(out["size"], pa.int64()), batch.column("doc_id"), pa.array(out["parts"], pa.list_(pa.int32()))]
            names = ["bucket", "id", "place", "doc_id", "parts"]
            yield pa.RecordBatch.from_arrays(heads, names)
            for low in range(0, len(buckets), 256):
                b = np.concatenate(buckets[low : low + 256])
                tail = [pa.array(b), pa.array(np.concatenate(owners[low : low + 256])), pa.array(np.concatenate(places[low : low + 256])), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(tail, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(emit, "bucket long, id long, place long, doc_id long, parts array<int>")


def token_sets(docs: DataFrame, n: int, known: DataFrame) -> DataFrame:
    """(id, tokens) of the known sets (id, first), made from the documents ``first`` names.

    Two Bloom filters, of doc_ids and of set ids, leave most others out. Both are asked in one
    step: each Python step behind another holds one more worker per task, for the whole job.
    """
    context = docs.sparkSession.sparkContext
    firsts = context.broadcast(bloom.build(known.where("first IS NOT NULL").select(F.col("first").cast("long"))))
    wanted = context.broadcast(bloom.build(known.select("id")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, chars=BATCH_CHARS):
            keys = batch.column("doc_id")
            let_in = bloom.passes(firsts.value, pc.fill_null(keys, 0).to_numpy()) | keys.is_null().to_numpy(zero_copy_only=False)
            sets = shingles(batch.column("text").filter(pa.array(let_in)), n)
            for low in range(0, len(sets), 256):
                some = [s for s in sets[low : low + 256] if len(s)]
                ids = np.array([set_id(s) for s in some], np.int64)
                met = bloom.passes(wanted.value, ids)
                some = [s for s, m in zip(some, met.tolist()) if m]
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in some]))), pa.int32()), pa.array(np.concatenate(some or [np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), tokens], ["id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "id long, tokens array<bigint>")


def by_size(postings: DataFrame, percent: int) -> DataFrame:
    """Length filter on buckets: each is split into classes of sizes within the ratio.

    An item goes to the class of its size and to the next, so two sizes within
    the ratio always share one.
    """
    # one part in a thousand wider, so that rounding never parts a pair
    width = math.log(100 / percent) * 1.001 + 1e-9
    own = F.floor(F.log(F.shiftright("place", 32).cast("double")) / width).cast("int")
    spread = postings.withColumn("class", F.explode(F.array(own, own + 1)))
    return spread.select(F.xxhash64("bucket", "class").alias("bucket"), "id", "place", "lead")


def size_alone(percent: int):
    """Length filter on places."""

    def could_link(x: Column, y: Column) -> Column:
        size_x, size_y = F.shiftright(x, 32), F.shiftright(y, 32)
        return 100 * F.least(size_x, size_y) >= percent * F.greatest(size_x, size_y)

    return could_link


def size_and_position(percent: int):
    """Length and positional filter on places (size in the upper half, position in the lower).

    The overlap is at most what is left from the shared token on if it is the
    rarest one in common; similar sets pass in the bucket of that token.
    """

    def could_link(x: Column, y: Column) -> Column:
        size_x, size_y = F.shiftright(x, 32), F.shiftright(y, 32)
        left = F.least(size_x - x.bitwiseAND(0xFFFFFFFF), size_y - y.bitwiseAND(0xFFFFFFFF))
        longest, shortest = F.greatest(size_x, size_y), F.least(size_x, size_y)
        return (100 * shortest >= percent * longest) & ((100 + percent) * left >= percent * (size_x + size_y))

    return could_link


def join_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id its links lead to).

    ``percent`` is the least Jaccard similarity in hundredths, ends included.
    """
    rows = written(prefixes(docs, n, percent, frequency_cells(docs, n)), "prefixes")
    heads = rows.where("bucket IS NULL").select("doc_id", F.col("id").alias("set_id"), F.col("place").alias("n_shingles"), "parts")
    tokens = rows.where("bucket IS NOT NULL").select("bucket", "id", "place", F.lit(True).alias("lead"))
    met = shared_buckets(tokens, "tokens-met")
    postings = shared_buckets(by_size(met, percent), "postings")
    drop(met)
    parts = heads.where("parts IS NOT NULL").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("size"), F.first("parts").alias("parts"))
    wanted = postings.select("id").distinct()
    known = written(parts.join(wanted, "id", "left_semi"), "sets")
    # filters of fixed size instead of a join: sets beyond the wanted ones meet no pair
    sets = written(token_sets(docs, n, known), "tokens")
    scratch: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        def side(name: str) -> DataFrame:
            return known.select(F.col("id").alias(name), F.col("size").alias(f"size_{name}"), F.col("parts").alias(f"parts_{name}"))

        near = pairs.join(side("a"), "a").join(side("b"), "b")
        apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
        total = F.col("size_a") + F.col("size_b")
        # overlap >= percent/(100+percent) * total, so the sets differ in the rest
        near = written(near.where((100 + percent) * apart <= (100 - percent) * total).select("a", "b", total.alias("total")), "near")
        scratch.append(near)
        # a round asks for few of the sets; the others stay out of its shuffles
        asked = bloom.matching(sets, "id", near.select(F.explode(F.array("a", "b"))))
        left = near.join(asked.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        both = left.join(asked.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return both.where(100 * common >= percent * (F.col("total") - common)).select("a", "b")

    labels = link_classes(postings, verify, size_and_position(percent), size_alone(percent))
    drop(postings, known, sets, *scratch)
    found = heads.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    classed = found.select("doc_id", "n_shingles", F.coalesce("label", "set_id").alias("class"))
    # written, so that the join can split a class that holds a large share of the rows
    least = written(classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")), "classes")
    return classed.join(least, "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
