"""Near-duplicate lines by a segment-partition edit join.

Two lines within k edits share one of k + 1 segments of the shorter one, and the
place of the shared part in the longer one shifts by few characters only. Each
line is cut into k + 1 even segments; it is put into a bucket per (length,
segment number, substring) for every length up to k below its own and every
substring that a match could need (the shifts on both sides of the segment are
bounded by the errors left for them). Buckets of a line's own segments lead.
Pairs that meet are verified by the banded bit-parallel edit distance; linked
lines form a class, and only its first line, by doc_id and place, stays.

Lines are compared without their outer blanks. Lines below ``min_chars`` are
not compared by edits: a few turn any short line into any other. Equal lines are
one item from the start and need their hash alone: those of ``exact_chars`` and
more are duplicates, of one character and more in op3 and the pipeline. Blank
lines always stay.

Rows: null texts have no lines and stay null; rows with equal doc_id are told apart
by their text, and rows equal in both are one document: they keep and lose the same
lines; an empty table gives no rows; other columns stay, whatever their names, but for
``n_dropped``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .editdistance import within
from .linking import link_classes, shared_buckets
from .store import drop, written

MAX_EDITS, MIN_CHARS = 2, 32
EDGES = " \t\n\v\f\r"


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 even segments; the longer ones last."""
    size, longer = divmod(length, k + 1)
    sizes = [size] * (k + 1 - longer) + [size + 1] * longer
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def probes(length: int, k: int) -> list[tuple[int, int, int, int, bool]]:
    """(length of the other line, segment, start, size, own) to look up for a line.

    With i segments before the shared one, at most i errors lie before it and
    k - i behind, which bounds the shift on either side.
    """
    out = []
    for other in range(max(k + 1, length - k), length + 1):
        extra = length - other
        for i, (start, size) in enumerate(segments(other, k)):
            low = max(0, start - i, start + extra - (k - i))
            high = min(length - size, start + i, start + extra + (k - i))
            out += [(other, i, at, size, extra == 0 and at == start) for at in range(low, high + 1)]
    return out


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def line_places(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """Every line of ``exact_chars``: id, row_key, number in its text, chars, and whether edits count."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, numbers, chars, long = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                for number, raw in enumerate((text.as_py() or "").split("\n")):
                    line = raw.strip(EDGES)
                    if len(line) >= exact_chars:
                        rows.append(row), ids.append(line_id(line)), numbers.append(number), chars.append(len(raw)), long.append(len(line) >= min_chars)
            keys = batch.column("row_key").take(pa.array(rows, pa.int64())).cast(KEY_TYPE)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), keys, pa.array(numbers, pa.int32()), pa.array(chars, pa.int64()), pa.array(long, pa.bool_())], ["id", "row_key", "number", "chars", "long"])

    return docs.select("row_key", "text").mapInArrow(emit, "id long, row_key struct<doc_id:long,twin:long>, number int, chars long, long boolean")


def line_buckets(docs: DataFrame, k: int, min_chars: int) -> DataFrame:
    """Buckets of the long lines, of each distinct line once per task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        seen: set[int] = set()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            buckets, ids, leads, places = [], [], [], []
            for text in batch.column("text"):
                for raw in (text.as_py() or "").split("\n"):
                    line = raw.strip(EDGES)
                    if len(line) < min_chars or (own := line_id(line)) in seen:
                        continue
                    seen.add(own)
                    size = len(line)
                    if size not in plans:
                        plans[size] = [(start, start + width, (other * 8 + i) << 32, lead) for other, i, start, width, lead in probes(size, k)]
                    for start, stop, seed, lead in plans[size]:
                        buckets.append(digest(line[start:stop], seed))
                        leads.append(lead)
                    ids.append(own)
                    places.append((size, len(plans[size])))
                if len(buckets) > 400_000:
                    yield _bucket_rows(buckets, ids, leads, places)
                    buckets, ids, leads, places = [], [], [], []
            if buckets:
                yield _bucket_rows(buckets, ids, leads, places)

    return docs.select("text").mapInArrow(emit, "bucket long, id long, place long, lead boolean")


KEY_TYPE = pa.struct([("doc_id", pa.int64()), ("twin", pa.int64())])


def _bucket_rows(buckets: list, ids: list, leads: list, places: list) -> pa.RecordBatch:
    repeat = np.array([p[1] for p in places])
    columns = [pa.array(np.array(buckets, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), repeat)), pa.array(np.repeat(np.array([p[0] for p in places], np.int64), repeat)), pa.array(leads, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "id", "place", "lead"])


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the key of a row: its doc_id, and a hash of its text to tell rows with equal doc_id apart."""
    return docs.withColumn("row_key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin")))


def line_texts(docs: DataFrame, min_chars: int, wanted: DataFrame) -> DataFrame:
    """(id, line, signature) of the long lines with a wanted id; a Bloom filter keeps the others out of the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, lines = [], []
            for text in batch.column("text"):
                for raw in (text.as_py() or "").split("\n"):
                    line = raw.strip(EDGES)
                    if len(line) >= min_chars and (own := line_id(line)) not in seen:
                        seen.add(own)
                        ids.append(own)
                        lines.append(line)
            found = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])
            found = found.filter(pa.array(bloom.passes(bits.value, np.array(ids, np.int64)), pa.bool_()))
            marks = pa.array([signature(x) for x in found.column("line").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*found.columns, marks], ["id", "line", "signature"])

    return docs.select("text").mapInArrow(emit, "id long, line string, signature long").join(wanted, "id", "left_semi").dropDuplicates(["id"])


def signature(line: str) -> int:
    """Sixteen counters of four bits: how many characters fall into each class, modulo sixteen."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") % 16
    counts = np.bincount(codes, minlength=16) % 16
    return int((counts.astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64)).sum().astype(np.int64))


def edit_filter(k: int):
    """Filter on places (length, signature): an edit changes the length by one and two counters by one each, at most."""

    def could_link(x: Column, y: Column) -> Column:
        apart = F.lit(0)
        for shift in range(0, 64, 4):
            step = (F.shiftright(x["signature"], shift).bitwiseAND(15) - F.shiftright(y["signature"], shift).bitwiseAND(15)).bitwiseAND(15)
            apart = apart + F.least(step, 16 - step)
        return (F.abs(x["length"] - y["length"]) <= k) & (apart <= 2 * k)

    return could_link


def verified(k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = within(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), k)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return verify


def duplicate_lines(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Lines (row_key, number, chars, long, dropped) of keyed documents; those below ``exact_chars``, by default ``min_chars``, are left out."""
    least = min_chars if exact_chars is None else min(max(1, exact_chars), min_chars)
    lines = written(line_places(docs, min_chars, least), "lines")
    postings = shared_buckets(line_buckets(docs, k, min_chars), "segments")
    texts = written(line_texts(docs, min_chars, postings.select("id").distinct()), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
        both = left.join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
        return both.select("a", "b", "line_a", "line_b").mapInArrow(verified(k), "a long, b long")

    place = F.struct(F.col("place").alias("length"), "signature")
    marked = postings.join(texts.select("id", "signature"), "id").withColumn("place", place).drop("signature")
    segments_ = written(marked, "segments")
    drop(postings)
    labels = link_classes(segments_, verify, edit_filter(k))
    drop(segments_, texts)
    classed = lines.join(labels, "id", "left").select(F.coalesce("label", "id").alias("class"), "row_key", "number", "chars", "long")
    # written, so that the join can split a line that holds a large share of the rows
    first = written(classed.groupBy("class").agg(F.min(F.struct("row_key", "number")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first-lines")
    found = classed.join(first, "class", "left")
    dropped = F.coalesce(F.struct("row_key", "number") != F.col("first"), F.lit(False))
    return found.select("row_key", "number", "chars", "long", dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Documents without near-duplicate lines; ``n_dropped`` tells how many went."""
    names = [c for c in docs.columns if c != "n_dropped"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    own = keyed(own).drop("doc_id")
    gone = duplicate_lines(own, k, min_chars, exact_chars).where("dropped").groupBy("row_key").agg(F.collect_set("number").alias("gone"))
    joined = own.join(gone, "row_key", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names], F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))
