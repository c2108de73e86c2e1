"""Distributed positional inverted index, for phrases of benchmark items.

Documents are grouped into shards of a bounded number of words as they are read.
A shard stores, for each of its terms, the sorted places of the term; places run
on over the shard's documents, with a gap no phrase can bridge. Postings of all
training tokens are kept. A search reads the postings of terms that the items
use, per shard, and intersects the lists of a window from the shard's rarest
term on, each shifted by its offset in the window, until a list empties it.
Proximity finds every least span that holds all terms of a window in any order,
by a merge of the terms' lists around the places of the rarest one.

Items are searched in blocks of bounded size; blocks only add rows.

Rows: null texts and texts without words have no places, and items without words
no window; equal doc_ids are separate rows; an equal item_id counts once; empty
tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .tokenizing import text_batches

SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP = 256
SHARD_CHARS = 12_000_000
BLOCK_WORDS = 500_000
INDEX = "shard long, term string, n long, places binary, doc_id long, number int, n_words long"
MATCH = "shard long, number int, item_id long, kind string, start long, stop long"


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z folded, in one array, and the number of words of each text."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels misread sliced arrays
    folded = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.ascii_trim(pc.replace_substring_regex(folded, SPLIT, " "), " ")
    lists = pc.split_pattern(spaced, " ")
    counts = np.where(pc.equal(spaced, "").to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    return flat.filter(pc.not_equal(flat, "")), counts.astype(np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """The index as a written table: term rows, and one row per document (term null)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        names = ["shard", "term", "n", "places", "doc_id", "number", "n_words"]
        for batch in text_batches(batches, chars=SHARD_CHARS):
            shard = task << 24 | made
            made += 1
            words, counts = word_lists(batch.column("text"))
            rows = len(counts)
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, shard)), pa.nulls(rows, pa.string()), none, pa.nulls(rows, pa.binary()), batch.column("doc_id"), pa.array(np.arange(rows), pa.int32()), pa.array(counts)], names)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            places = (np.arange(len(codes)) + np.repeat(np.arange(rows) * GAP, counts)).astype("<i4")
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            listed = places[order]
            steps = np.diff(listed, prepend=0).astype("<i4")
            steps[bounds[:-1]] = listed[bounds[:-1]]
            terms = coded.dictionary
            for low in range(0, len(terms), 100_000):
                part = slice(low, min(low + 100_000, len(terms)))
                n = part.stop - low
                own = bounds[low : part.stop + 1]
                data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(((own - own[0]) * 4).astype(np.int32).tobytes()), pa.py_buffer(steps[own[0] : own[-1]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), terms.slice(low, n).cast(pa.string()), pa.array(sizes[part]), data, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(index, INDEX), "index")


class Windows:
    """Windows of a block of items, and their sets of terms: term numbers, and the items they come from."""

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        self.terms: dict[str, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        words, counts = word_lists(pa.array([t for _, t in items], pa.string()))
        flat, end = words.to_pylist(), 0
        for (item, _), count in zip(items, counts.tolist()):
            own = [self.terms.setdefault(w, len(self.terms)) for w in flat[end : end + count]]
            end += count
            width = min(size, len(own))
            for i in range(len(own) - width + 1 if own else 0):
                window = tuple(own[i : i + width])
                found.setdefault(window, set()).add(item)
        self.windows = [(np.array(w), sorted(items_)) for w, items_ in found.items()]
        sets: dict[tuple[int, ...], set[int]] = {}
        for window, items_ in found.items():
            sets.setdefault(tuple(sorted(set(window))), set()).update(items_)
        #: terms of windows in any order, for proximity
        self.sets = [(np.array(t), sorted(items_)) for t, items_ in sets.items()]


class Postings:
    """Lists of one shard, by term number; absent terms have none."""

    def __init__(self, terms: dict[str, int], batch: pa.Table):
        self.lists: list[np.ndarray | None] = [None] * len(terms)
        for term, places in zip(batch.column("term").to_pylist(), batch.column("places").to_pylist()):
            if term in terms:
                self.lists[terms[term]] = np.cumsum(np.frombuffer(places, "<i4"), dtype=np.int64)
        self.sizes = np.array([0 if x is None else len(x) for x in self.lists])
        self.paired: dict[tuple[int, ...], np.ndarray] = {}

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Places where the window begins."""
        order = np.argsort(self.sizes[window], kind="stable")
        starts = self.lists[window[order[0]]] - order[0]
        for at in order[1:]:
            other = self.lists[window[at]]
            spot = np.searchsorted(other, starts + at)
            starts = starts[other[np.minimum(spot, len(other) - 1)] == starts + at]
            if not len(starts):
                break
        return starts

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """(first, last) place of every least span of at most ``span`` words that holds all of the distinct terms."""
        order = terms[np.argsort(self.sizes[terms], kind="stable")]
        pair = tuple(order[:2].tolist())
        if pair not in self.paired:
            self.paired[pair] = self._beside(self.lists[pair[0]], pair[-1], span)
        anchor = self.paired[pair]
        for term in order[2:]:
            if not len(anchor):
                return []
            anchor = self._beside(anchor, term, span)
        if not len(anchor):
            return []
        # stretches of places that a span around an anchor can reach
        apart = np.flatnonzero(np.diff(anchor) >= 2 * span - 1)
        low = anchor[np.concatenate(([0], apart + 1))] - span + 1
        high = anchor[np.concatenate((apart, [len(anchor) - 1]))] + span - 1
        reached = []
        for term in order:
            other = self.lists[term]
            first, last = np.searchsorted(other, low), np.searchsorted(other, high, side="right")
            n = last - first
            reached.append(other[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
        places = np.concatenate(reached)
        which = np.repeat(np.arange(len(order)), [len(r) for r in reached])
        merged = np.argsort(places, kind="stable")
        places, which = places[merged], which[merged]
        # the shortest span that ends at a place begins at the term that was seen last the longest ago
        begin = places.copy()
        for t in range(len(order)):
            begin = np.minimum(begin, np.maximum.accumulate(np.where(which == t, places, -(2**62))))
        least = np.concatenate(([True], begin[1:] > begin[:-1])) & (places - begin < span)
        return list(zip(begin[least].tolist(), places[least].tolist()))

    def _beside(self, anchor: np.ndarray, term: int, span: int) -> np.ndarray:
        """Anchors with a place of the term less than ``span`` away."""
        other = self.lists[term]
        spot = np.searchsorted(other, anchor - span + 1)
        return anchor[(spot < len(other)) & (other[np.minimum(spot, len(other) - 1)] < anchor + span)]


def search(index: DataFrame, items: DataFrame, size: int = 13, span: int | None = None) -> DataFrame:
    """Matches (shard, number, item_id, kind, start, stop): words start..stop of a document.

    ``phrase`` rows cover runs of overlapping window occurrences of an item;
    ``near`` rows, asked for by ``span``, cover runs of overlapping least spans of
    at most so many words that hold all terms of one of the item's windows.
    """
    if span and span > GAP:
        raise ValueError(f"span is at most {GAP} words")
    spark = index.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // (6 * BLOCK_WORDS) + 1
    parts = []
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()], size))
        parts.append(_search_block(index, windows, span))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _search_block(index: DataFrame, windows, span: int | None) -> DataFrame:
    terms = index.sparkSession.createDataFrame([(t,) for t in windows.value.terms], "term string")
    wanted = index.where("term IS NOT NULL").select("shard", "term", "places").join(F.broadcast(terms), "term", "left_semi")  # at most the words of a block
    starts = index.where("term IS NULL").select(F.col("shard").alias("of"), "number", "n_words")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {k: [] for k in ("shard", "number", "item_id", "kind", "start", "stop")}
        if len(left) and len(right):
            shard = left.column("shard")[0].as_py()
            docs = right.sort_by("number")
            counts = docs.column("n_words").to_numpy()
            begins = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP
            postings, plan = Postings(windows.value.terms, left), windows.value
            hits: dict[int, list[tuple[int, int]]] = {}
            nears: dict[int, list[tuple[int, int]]] = {}
            for window, owners in plan.windows:
                if not postings.sizes[window].all():
                    continue
                places = [(p, p + len(window)) for p in postings.phrase(window).tolist()]
                if places:
                    for item in owners:
                        hits.setdefault(item, []).extend(places)
            for terms, owners in plan.sets if span else []:
                if not postings.sizes[terms].all():
                    continue
                near = [(a, b + 1) for a, b in postings.near(terms, span)]
                if near:
                    for item in owners:
                        nears.setdefault(item, []).extend(near)
            for kind, by_item in (("phrase", hits), ("near", nears)):
                for item, spans in by_item.items():
                    for low, high in _merged(spans):
                        doc = int(np.searchsorted(begins, low, side="right")) - 1
                        found["number"].append(doc), found["item_id"].append(item), found["kind"].append(kind)
                        found["start"].append(low - int(begins[doc])), found["stop"].append(high - int(begins[doc]))
            found["shard"] = [shard] * len(found["number"])
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(found.values(), types)], names=list(found))

    return wanted.groupBy("shard").cogroup(starts.groupBy("of")).applyInArrow(look, MATCH)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, span: int | None = None, parts_of: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``n_hit`` counts words inside any window occurrence; a document is
    contaminated if they are at least one in ``parts_of``. ``n_near`` counts the
    items with a ``near`` match, if ``span`` is given; the verdict leaves it out.
    """
    index = build_index(docs)
    matches = written(search(index, items, size, span), "matches")
    doc = ["shard", "number"]
    before = Window.partitionBy(*doc).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    phrases = matches.where("kind = 'phrase'").withColumn("done", F.coalesce(F.max("stop").over(before), F.lit(0)))
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "done"))
    listed = F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",")
    hit = phrases.groupBy(*doc).agg(F.sum(covered).alias("n_hit"), F.countDistinct("item_id").alias("n_items"), listed.alias("items"))
    near = matches.where("kind = 'near'").groupBy(*doc).agg(F.countDistinct("item_id").alias("n_near"))
    base = index.where("term IS NULL").select(*doc, "doc_id", "n_words")
    joined = base.join(hit, doc, "left").join(near, doc, "left").na.fill(0, ["n_hit", "n_items", "n_near"]).na.fill("", ["items"])
    bad = (F.col("n_hit") > 0) & (parts_of * F.col("n_hit") >= F.col("n_words"))
    return joined.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), bad.alias("contaminated"), "n_near")
