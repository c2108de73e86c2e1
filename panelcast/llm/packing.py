"""Best-fit packing of documents into fixed-length training sequences.

A packing depends on lengths alone, so the plan is made on the histogram of
piece lengths (one count per length, at most ``capacity`` of them) and holds for
all rows at once. Pieces above a third of the capacity go at most two to a
sequence: the longest is matched with the longest that still fits, which gives
as many pairs as can be. Shorter pieces follow in falling length, each into the
tightest gap. Sequences with the same content are planned as one group, so the
plan stays bounded by the capacity whatever the number of rows. Each piece then
finds its place by its rank among the pieces of its length.

Rows: a null text is an empty document (its end id alone); equal and null
doc_ids are packed like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .tokenizing import encoder, text_batches


class Group:
    """Equal sequences: how many, what they hold as (length, copies), what is free."""

    def __init__(self, bins: int, held: list[tuple[int, int]], capacity: int):
        self.bins, self.held, self.capacity = bins, held, capacity
        self.free = capacity - sum(length * copies for length, copies in held)

    def plus(self, bins: int, length: int, copies: int) -> Group:
        return Group(bins, [*self.held, (length, copies)], self.capacity)


def plan(counts: Mapping[int, int], capacity: int) -> list[Group]:
    """Groups of sequences for ``counts`` pieces per length."""
    left = {length: n for length, n in counts.items() if n}
    groups = _match_large(left, capacity)
    by_free: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        by_free[g.free].append(g)
    gaps = sorted(by_free)
    done: list[Group] = []

    def keep(g: Group) -> None:
        if g.free == 0:
            done.append(g)
            return
        if not by_free.get(g.free):
            insort(gaps, g.free)
        by_free[g.free].append(g)

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                full, rest = divmod(todo, capacity // length)
                if full:
                    keep(Group(full, [(length, capacity // length)], capacity))
                if rest:
                    keep(Group(1, [(length, rest)], capacity))
                break
            free = gaps[at]
            g = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], gaps[at]
            each = free // length
            full = min(g.bins, todo // each)
            rest = min(todo - full * each, each - 1) if full < g.bins else 0
            if full:
                keep(g.plus(full, length, each))
            if rest:
                keep(g.plus(1, length, rest))
            if spare := g.bins - full - (rest > 0):
                keep(Group(spare, g.held, capacity))
            todo -= full * each + rest
    return done + [g for gs in by_free.values() for g in gs]


def _match_large(left: Mapping[int, int], capacity: int) -> list[Group]:
    """Pieces above a third of the capacity, two to a sequence where a partner fits."""
    large = {k: n for k, n in left.items() if 3 * k > capacity}
    lengths, groups = sorted(large), []
    while lengths:
        top = lengths[-1]
        at = bisect_left(lengths, capacity - top + 1) - 1
        if at < 0:
            groups.append(Group(large[top], [(top, 1)], capacity))
            lengths.pop()
            continue
        other = lengths[at]
        if other == top:
            pairs = large[top] // 2
            if pairs:
                groups.append(Group(pairs, [(top, 2)], capacity))
            large[top] -= 2 * pairs
            if large[top] and at:
                _pair(large, lengths, top, lengths[at - 1], groups, capacity)
            elif large[top]:
                groups.append(Group(1, [(top, 1)], capacity))
                large[top] = 0
        else:
            _pair(large, lengths, top, other, groups, capacity)
        lengths = [k for k in lengths if large[k]]
    return groups


def _pair(large: dict[int, int], lengths: list[int], top: int, other: int, groups: list[Group], capacity: int) -> None:
    n = min(large[top], large[other])
    groups.append(Group(n, [(top, 1), (other, 1)], capacity))
    large[top] -= n
    large[other] -= n


def slots(groups: list[Group]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, copies, first sequence, offset), ranks rising."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for g in groups:
        offset = 0
        for length, copies in g.held:
            rows[length].append((taken[length], copies, base, offset))
            taken[length] += g.bins * copies
            offset += length * copies
        base += g.bins
    return {length: np.array(r, np.int64) for length, r in rows.items()}


PIECE = "doc_id long, piece int, start long, length int, ids binary, task int, nth long"


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, folded: bool) -> DataFrame:
    """Token pieces of every document, with their number among pieces of that length in the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(tokenizer, folded), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in text_batches(batches):
            flat, lengths = coder.encode(batch.column("text"))
            sizes = lengths + 1
            ends = np.cumsum(sizes)
            ids = np.full(int(ends[-1]), end_id, np.int32)
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = flat
            number = (sizes + capacity - 1) // capacity
            doc = np.repeat(np.arange(len(sizes)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            bounds = np.concatenate(([0], np.cumsum(length))) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            order = np.argsort(length, kind="stable")
            first = np.concatenate(([True], np.diff(length[order]) > 0))
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            nth = np.empty(len(order), np.int64)
            nth[order] = run + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), data.cast(pa.binary()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def pack(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, folded: bool = True) -> DataFrame:
    """Every piece with its ids, its sequence and its offset there."""
    cut = written(pieces(df, tokenizer, end_id, capacity, folded), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # one row per length: bounded by the capacity
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for low, high in zip(bounds[:-1], bounds[1:]):
                at = order[low:high]
                rows = table.value[int(length[at[0]])]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                bin_, copy = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at] = row[:, 2] + bin_
                offset[at] = row[:, 3] + copy * length[at]
            kept = batch.drop_columns(["task", "rank"])
            names = [*kept.schema.names, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names)

    narrow = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    ranked = narrow.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "task", (F.col("nth") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
