"""Collocations: phrases whose parts occur together more often than apart.

Texts are folded (A-Z) and cut into pieces at punctuation and line ends, pieces into
words. All counts are per language; a word of a language is a unit of its own, so one
table of ids serves all languages and pairs never cross them.

* Documents are encoded into shards of a bounded number of characters: the distinct
  words with their counts, and every word as a number among them.
* Counts of words are added up and the frequent words are numbered by falling
  frequency, over all data. Each shard learns the ids of its own words by a join, so
  no vocabulary is sent around. A phrase is never more frequent than its words, so the
  others end a run of words.
* Pairs of neighbours are counted by their addresses: the ids are split into tiles of
  TILE x TILE pairs. Frequent ids come first, so few tiles hold most pairs; a crowded
  tile is counted by ``numpy.bincount`` over all its cells, the pairs of the others as
  sorted coordinates. Spark adds up the shards' counts.
* Frequent pairs are ranked like words and take their places in the shards. Two
  neighbouring pairs are a phrase of three words, counted in the same way, and so on:
  a phrase is a pair of the phrases that leave out its last and its first word.

Each phrase carries the counts of all its beginnings and ends, from which the cuts are
scored in exact decimals. A phrase goes if a phrase of one word more that holds it is
at least half as frequent; longer ones need no look, since they are no more frequent
than that one.

Rows: a null text is empty, a null language is ``und``; equal rows count each; without
a frequent phrase there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.keys import row_index
from .store import written
from .tokenizing import text_batches

MIN_COUNT, MAX_WORDS, TOP, COVERED_PERCENT, SCALE = 10, 3, 2000, 50, 1_000_000
SHARD_CHARS = 8_000_000
TILE, GRID = 1024, 8
CROWD = TILE * TILE // 16
END = "\n"
UNKNOWN = "und"
SHARD = "shard long, words binary, entries array<struct<lang:string,word:string,n:bigint>>, totals array<struct<lang:string,n:bigint>>"
SEQUENCE = "shard long, units binary, ids binary"
COUNTS = "shard long, i long, j long, n long"


def pieces_and_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one array, END behind every piece, and the number of both per text."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels misread sliced arrays
    folded = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    cut = pc.replace_substring_regex(folded, "[.,;:!?\\x0A-\\x0D]+", f" {END} ")
    end, blank = (pa.scalar(x, pa.large_string()) for x in (END, " "))
    spaced = pc.binary_join_element_wise(pc.replace_substring(cut, "\t", " "), end, blank)
    lists = pc.split_pattern(spaced, " ")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), np.diff(before[bounds - bounds[0]])


def encoded(docs: DataFrame) -> DataFrame:
    """Shards: distinct words per language with counts, and the words as numbers among them, -1 between pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, chars=SHARD_CHARS):
            flat, sizes = pieces_and_words(batch.column("text"))
            coded, langs = flat.dictionary_encode(), batch.column("lang").dictionary_encode()
            word = coded.indices.to_numpy().astype(np.int64)
            lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
            end = pc.index(coded.dictionary, END).as_py()
            inside = word != end
            kinds, place, n = np.unique(lang[inside] * len(coded.dictionary) + word[inside], return_inverse=True, return_counts=True)
            numbers = np.full(len(word), -1, np.int32)
            numbers[inside] = place
            of_lang, of_word = np.divmod(kinds, len(coded.dictionary))
            names = langs.dictionary.take(pa.array(of_lang))
            strings = coded.dictionary.take(pa.array(of_word)).cast(pa.string())
            entries = pa.StructArray.from_arrays([names, strings, pa.array(n.astype(np.int64))], ["lang", "word", "n"])
            sums = np.bincount(of_lang, weights=n, minlength=len(langs.dictionary)).astype(np.int64)
            totals = pa.StructArray.from_arrays([langs.dictionary, pa.array(sums)], ["lang", "n"])
            row = [pa.array([task << 24 | made], pa.int64()), pa.array([numbers.tobytes()], pa.binary()), _listed(entries), _listed(totals)]
            made += 1
            yield pa.RecordBatch.from_arrays(row, ["shard", "words", "entries", "totals"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return written(rows.mapInArrow(encode, SHARD), "encoded")


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def ranked(counts: DataFrame, *keys: str) -> DataFrame:
    """Adds ``id``, the place by falling ``n``; ties by the keys. Written, so that ids stay as they are."""
    order = F.struct((-F.col("n")).alias("n"), *keys)
    return written(row_index(counts.withColumn("_order", order), "_order", "id").drop("_order"), "ranked")


def _sequence(shard: int, units: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A shard's row; runs of gaps shrink to one."""
    gap = units < 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return pa.table([pa.array([shard], pa.int64()), pa.array([units[keep].astype(np.int32).tobytes()], pa.binary()), pa.array([ids.astype(np.int64).tobytes()], pa.binary())], names=["shard", "units", "ids"])


def _first(shards: pa.Table, told: pa.Table) -> pa.Table:
    """The shard's words as numbers among its frequent ones, in order of their ids."""
    if not len(shards):
        return pa.table({"shard": pa.array([], pa.int64()), "units": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    words = np.frombuffer(shards.column("words")[0].as_py(), np.int32)
    place, ids = told.column("place").to_numpy(), told.column("id").to_numpy()
    order = np.argsort(ids)
    unit = np.full(max(words.max(initial=-1), place.max(initial=-1)) + 2, -1, np.int32)  # the last one stands for gaps
    unit[place[order]] = np.arange(len(order))
    return _sequence(shards.column("shard")[0].as_py(), unit[words], ids[order])


def word_sequences(shards: DataFrame, words: DataFrame) -> DataFrame:
    entries = shards.select("shard", F.posexplode("entries").alias("place", "e")).select("shard", "place", "e.lang", "e.word")
    told = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "place", "id")
    met = shards.select("shard", "words").groupBy("shard").cogroup(told.groupBy("of"))
    return written(met.applyInArrow(_first, SEQUENCE), "sequences")


def tile_counts(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n) of pairs of units; ``ids`` are the units' ids, rising."""
    i, j = ids[left], ids[right]
    near = np.flatnonzero((i < GRID * TILE) & (j < GRID * TILE))
    tile = i[near] // TILE * GRID + j[near] // TILE
    crowded = np.flatnonzero(np.bincount(tile, minlength=GRID * GRID) >= CROWD)
    parts, rest = [], np.ones(len(i), bool)
    for t in crowded.tolist():
        at = near[tile == t]
        rest[at] = False
        low_i, low_j = t // GRID * TILE, t % GRID * TILE
        cells = np.bincount((i[at] - low_i) * TILE + j[at] - low_j, minlength=TILE * TILE)
        full = np.flatnonzero(cells)
        parts.append((low_i + full // TILE, low_j + full % TILE, cells[full]))
    code = np.sort(left[rest].astype(np.int64) << 32 | right[rest])
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    parts.append((ids[code[starts] >> 32], ids[code[starts] & 0xFFFFFFFF], np.diff(starts, append=len(code))))
    return tuple(np.concatenate(p) for p in zip(*parts))


def pair_counts(sequences: DataFrame) -> DataFrame:
    """(shard, i, j, n) of neighbouring units."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                units, ids = np.frombuffer(row["units"], np.int32), np.frombuffer(row["ids"], np.int64)
                both = np.flatnonzero((units[:-1] >= 0) & (units[1:] >= 0))
                i, j, n = tile_counts(units[both], units[both + 1], ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["shard"])), pa.array(i), pa.array(j), pa.array(n.astype(np.int64))], ["shard", "i", "j", "n"])

    return sequences.mapInArrow(count, COUNTS)


def frequent_pairs(counts: DataFrame, min_count: int) -> DataFrame:
    """(shard, i, j, n, head) of pairs that are frequent over all shards, ``n`` their whole count, one row of each a head; written.

    One shuffle serves the sum and the way back to the shards. A pair has a row per
    shard at most.
    """
    pair = Window.partitionBy("i", "j")
    summed = counts.withColumns({"n": F.sum("n").over(pair), "head": F.row_number().over(pair.orderBy("shard")) == 1})
    return written(summed.where(F.col("n") >= min_count), "frequent-pairs")


def _longer(rows: pa.Table, told: pa.Table) -> pa.Table:
    """The shard with each pair of units as one unit at the place of its first, in order of the pairs' ids."""
    if not len(rows):
        return rows
    units, ids = (np.frombuffer(rows.column(c)[0].as_py(), t) for c, t in (("units", np.int32), ("ids", np.int64)))
    told = told.sort_by("id")
    known = np.searchsorted(ids, told.column("i").to_numpy()) << 32 | np.searchsorted(ids, told.column("j").to_numpy())
    order = np.argsort(known)
    found = np.full(max(0, len(units) - 1), -1, np.int32)
    if len(known):
        code = units[:-1].astype(np.int64) << 32 | units[1:].clip(0)
        at = np.searchsorted(known[order], code).clip(0, len(known) - 1)
        hit = (known[order][at] == code) & (units[1:] >= 0)
        found[hit] = order[at[hit]]
    return _sequence(rows.column("shard")[0].as_py(), found, told.column("id").to_numpy())


def longer_sequences(sequences: DataFrame, frequent: DataFrame, pairs: DataFrame) -> DataFrame:
    told = frequent.select("shard", "i", "j").join(pairs.select("i", "j", "id"), ["i", "j"]).withColumnRenamed("shard", "of")
    met = sequences.groupBy("shard").cogroup(told.groupBy("of"))
    return written(met.applyInArrow(_longer, SEQUENCE), "sequences")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in decimals of 38 digits."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), left * right)


def phrases(pairs: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words from pairs of phrases of one word less, with their lowest-scoring cut; written.

    ``lefts`` and ``rights`` hold the counts of the first and of the last 1, 2 … words.
    """
    first = parts.select(F.col("id").alias("i"), "lang", "phrase", F.col("lefts").alias("lefts_i"))
    second = parts.select(F.col("id").alias("j"), "last", F.col("rights").alias("rights_j"))
    joined = pairs.withColumnRenamed("n", "a").join(first, "i").join(second, "j")
    cuts = []
    for k in range(1, size):
        left, right = F.element_at("lefts_i", k), F.element_at("rights_j", size - k)
        cuts.append(F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    cut = F.array_min(F.array(*cuts))
    found = joined.select(
        "id", "i", "j", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", cut.alias("cut"),
        F.array_append("lefts_i", F.col("a")).alias("lefts"), F.array_append("rights_j", F.col("a")).alias("rights"),
    )
    return written(found.select("*", "cut.score", "cut.l", "cut.r").drop("cut"), "phrases")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """Each language's best phrases of two to ``max_words`` words: lang, rank, phrase, a, l, r, n, score."""
    shards = encoded(docs)
    totals = shards.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n"))
    counts = shards.select(F.inline("entries")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = ranked(counts.where(F.col("n") >= min_count), "lang", "word")
    known = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("lefts"), F.array("n").alias("rights"))
    sequences, found = word_sequences(shards, words), []
    for size in range(2, max_words + 1):
        met = pair_counts(sequences)
        if size < max_words:
            frequent = frequent_pairs(met, min_count)
            pairs = ranked(frequent.where("head").select("i", "j", "n"), "i", "j")
            sequences = longer_sequences(sequences, frequent, pairs)
        else:
            pairs = ranked(met.groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "i", "j")
        known = phrases(pairs, known, size)
        found.append(known)
    kept = [_uncovered(short, long, covered_percent) for short, long in zip(found, found[1:])] + found[-1:]
    rows = None
    for part in kept:
        part = part.select("lang", "phrase", "a", "l", "r", "score")
        rows = part if rows is None else rows.unionAll(part)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    cut = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return cut.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _uncovered(short: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Phrases that no phrase of one word more covers."""
    held = long.select(F.col("i").alias("id"), "a").unionAll(long.select("j", "a")).groupBy("id").agg(F.max("a").alias("longest"))
    joined = short.join(held, "id", "left")
    return joined.where(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("a")))
