"""Stupid-backoff scores of documents under an n-gram model of the whole corpus.

A word given the words before it scores count(n-gram) / count(context) if the
n-gram occurs at least twice in the corpus, else 0.4 times its score given one
word less, down to its share of all words; a document's score is the sum of the
natural logarithms over its words. The order is two unless asked for otherwise.

There is no vocabulary: words and n-grams are keyed by 64-bit hashes, so each
keeps its own count however many there are (two of a billion n-grams share a key
with a probability of about 3 %). Documents are encoded into shards of a bounded
number of characters. A shard reduces the n-grams of every order to distinct
ones, sorted, and sends them to buckets by ranges of the hash; a bucket adds the
shards' counts up and answers each shard in the order it asked, so a frequent
n-gram costs one entry per shard, never one per occurrence. The answers meet the
shard again and are summed per document. The driver learns one number, the count
of all words.

Rows: null and blank texts have no words, score 0; equal doc_ids are separate
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import written
from .tokenizing import text_batches

ORDER, MIN_PAIRS, BACKOFF = 2, 2, 0.4
SHARD_CHARS, BUCKET_WORDS = 8_000_000, 2_000_000
SHARD = "shard long, n long, docs binary, sizes binary, hashes binary, words binary"
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between blanks, A-Z folded, in one array, and their number per text."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels misread sliced arrays
    folded = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(folded)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    real = np.concatenate(([0], np.cumsum(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))))
    return flat.filter(pc.not_equal(flat, "")), np.diff(real[bounds - bounds[0]])


def encoded(docs: DataFrame, shard_chars: int | None = None) -> DataFrame:
    """Shards of documents: hashes of their distinct words, and every word as a number among them; written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, chars=shard_chars or SHARD_CHARS):
            words, sizes = word_lists(batch.column("text"))
            coded = words.dictionary_encode()
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            numbers = coded.indices.to_numpy().astype(np.uint32)
            docs_ = batch.column("doc_id")
            missing = docs_.is_null().to_numpy(zero_copy_only=False)
            ids = np.where(missing, -(2**63), pc.fill_null(docs_, 0).to_numpy()).astype(np.int64)
            row = {"shard": task << 24 | made, "n": len(numbers), "docs": ids.tobytes(), "sizes": sizes.astype(np.int64).tobytes(), "hashes": own.tobytes(), "words": numbers.tobytes()}
            made += 1
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("words", pa.binary())]))

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SHARD), "encoded")


def _grams(hashes: bytes, words: bytes, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams of each order that end at each word, and the number of words before it, ``order - 1`` at most."""
    keys = [np.frombuffer(hashes, np.uint64)[np.frombuffer(words, np.uint32)]]
    for _ in range(order - 1):
        longer = keys[0].copy()
        longer[1:] += (keys[-1][:-1] + np.uint64(1)) * MIX
        keys.append(longer)
    before = np.full(len(keys[0]), order - 1, np.int8)
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[sizes > 0]
    for n in range(order - 2, -1, -1):
        at = starts + n
        before[at[at < ends[sizes > 0]]] = n
    return keys, before


def _distinct(keys: list[np.ndarray], before: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted distinct keys, their place per n-gram, and their counts, by order."""
    return [np.unique(k[before >= n], return_inverse=True, return_counts=True) for n, k in enumerate(keys)]


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets, which are even ranges of the hash, in sorted keys."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of the numbers, highest bytes together, so that zeros compress."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def gram_counts(shards: DataFrame, buckets: int, order: int = ORDER) -> DataFrame:
    """(shard, n, bucket, totals): corpus counts of a shard's distinct n-grams of n + 1 words, in its own order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("shard", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                found = _distinct(*_grams(row["hashes"], row["words"], np.frombuffer(row["sizes"], np.int64), order))
                for n, (keys, _, counts) in enumerate(found):
                    bounds = _bounds(keys, buckets)
                    filled = np.flatnonzero(np.diff(bounds))
                    if not len(filled):
                        continue
                    parts = [slice(a, b) for a, b in zip(bounds[filled].tolist(), bounds[filled + 1].tolist())]
                    steps = np.diff(keys, prepend=np.uint64(0))
                    steps[bounds[filled]] = keys[bounds[filled]]  # a message starts with a whole key
                    counts = counts.astype(np.uint32)
                    same = [np.full(len(filled), v) for v in (n, row["shard"])]
                    data = [[_planes(numbers[p]) for p in parts] for numbers in (steps, counts)]
                    # one batch per shard and order, a row for each bucket
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([filled, *same, *data], kinds.types)], schema=kinds)

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        keys = [np.cumsum(_numbers(s, np.uint64), dtype=np.uint64) for s in rows.column("steps").to_pylist()]
        counts = [_numbers(c, np.uint32) for c in rows.column("counts").to_pylist()]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts))[inverse].astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        parts = [_planes(t) for t in np.split(totals, ends[:-1])]
        return pa.table({"shard": rows.column("shard"), "n": rows.column("n"), "bucket": rows.column("bucket"), "totals": pa.array(parts, pa.binary())})

    asked = shards.select("shard", "sizes", "hashes", "words").mapInArrow(ask, "bucket int, n int, shard long, steps binary, counts binary")
    return written(asked.groupBy("n", "bucket").applyInArrow(answer, "shard long, n int, bucket int, totals binary"), "gram-counts")


def score(docs: DataFrame, order: int = ORDER, shard_chars: int | None = None, bucket_words: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_backoff (words whose longest n-gram isn't frequent), log_score.

    ``shard_chars`` and ``bucket_words`` bound what a task holds and change no result. A
    shard sends one message to each bucket, so messages get shorter as the corpus grows;
    where executors have more memory, larger values of both keep them long.
    """
    shards = encoded(docs, shard_chars)
    total = shards.agg(F.sum("n")).first()[0] or 0
    buckets = total // (bucket_words or BUCKET_WORDS) + 1
    answers = gram_counts(shards, buckets, order)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_backoff": [], "log_score": []}
        for row in left.to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int64)
            keys, before = _grams(row["hashes"], row["words"], sizes, order)
            told = [dict() for _ in range(order)]
            for n, bucket, data in zip(*(right.column(c).to_pylist() for c in ("n", "bucket", "totals"))):
                told[n][bucket] = _numbers(data, np.int64)
            counts = []
            for n, (_, inverse, _) in enumerate(_distinct(keys, before)):
                held = np.zeros(row["n"], np.int64)
                if len(inverse):
                    held[before >= n] = np.concatenate([told[n][b] for b in sorted(told[n])])[inverse]
                counts.append(held)
            logs = np.log(np.maximum(counts[0], 1)) - math.log(max(total, 1))
            frequent = np.ones(row["n"], bool)
            for n in range(1, order):
                context = np.log(np.maximum(np.concatenate(([0], counts[n - 1][:-1])), 1)) if row["n"] else logs
                # words with fewer words before them keep what a shorter n-gram gave
                longer, often = before >= n, counts[n] >= MIN_PAIRS
                logs = np.where(longer, np.where(often, np.log(np.maximum(counts[n], 1)) - context, logs + math.log(BACKOFF)), logs)
                frequent = np.where(longer, often, frequent)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            sums = np.array([math.fsum(logs[a:b]) for a, b in zip(ends[:-1], ends[1:])])
            misses = np.concatenate(([0], np.cumsum(~frequent)))
            ids = np.frombuffer(row["docs"], np.int64)
            out["doc_id"] += [None if i == -(2**63) else i for i in ids.tolist()]
            out["n_words"] += sizes.tolist()
            out["n_backoff"] += (misses[ends[1:]] - misses[ends[:-1]]).tolist()
            out["log_score"] += sums.tolist()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    met = shards.groupBy("shard").cogroup(answers.groupBy("shard"))
    return met.applyInArrow(add, "doc_id long, n_words long, n_backoff long, log_score double")
