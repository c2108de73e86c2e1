"""Re-Pair grammar compression of token ids, per shard, with random access.

Pairs of ids that occur often in a shard become nonterminals, round after
round: in a round every pair that is more frequent than the pairs overlapping
it is replaced, all of them at once, until no pair has places enough to pay for
a rule. Rules of a shard are two arrays (left, right) and the number of ids each
expands to. Pairs never cross a document, so any document is a slice of the
sequence.

Rows: null texts count as empty; rows with equal or null ids stay as they are,
null first; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tokenizing import encoder, text_batches

SHARD_IDS = 2_000_000
# A rule is three numbers (left, right, length) and a place saves one: four places pay.
MIN_COUNT = 4
SHARD = "part int, shard int, start long, n_tokens long, base int, docs binary, sizes binary, sequence binary, symbols binary, left binary, right binary, expands binary, rounds binary"


def compress(ids: np.ndarray, sizes: np.ndarray, base: int, min_count: int = MIN_COUNT) -> dict:
    """Grammar of the concatenated ids of some documents; ``sizes`` are ids per document.

    Places are linked to the next and the one before, so a round touches only places whose
    pair can still be frequent: those that were frequent, and those beside a replacement.
    A pair of old symbols never gains a place.
    """
    n = len(ids)
    seq = np.append(ids, 0).astype(np.uint32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    last, gone = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    last[n] = True
    left, right, rounds, fresh, turn = [], [], [], base, 0
    places = np.flatnonzero(~last)
    while len(places):
        key, slot, own, table = _slots(seq[places], seq[after[places]], turn)
        turn += 1
        follows = after[places[:-1]] == places[1:]
        counted = own & _every_other(key, follows)
        count = np.bincount(slot[counted], minlength=len(table))[slot]
        often = own & (count >= min_count)
        # equal counts are told apart by the pair, so that repeated passages shrink all along
        weight = np.where(counted & often, count * len(table) + slot, 0)
        picked = _peaks(weight, follows)
        used = np.bincount(slot[picked], minlength=len(table))
        cells = np.flatnonzero(used >= min_count)
        number = np.zeros(len(table), np.uint32)
        number[cells] = np.arange(fresh, fresh + len(cells), dtype=np.uint32)
        # the other places of the pairs that became rules, as far as they don't overlap
        named = number[slot]
        picked &= named > 0
        free = (weight > 0) & (named > 0) & ~picked & ~_beside(picked, follows)
        while free.any():
            more = _peaks(np.where(free, weight, 0), follows)
            picked |= more
            free &= ~more & ~_beside(more, follows)
        at = places[picked]
        second = after[at]
        seq[at] = named[picked]
        last[at] = last[second]
        after[at] = after[second]
        before[after[second]] = at
        gone[second] = True
        open_ = np.zeros(n + 1, bool)
        open_[places[often | ~own]] = True
        open_[at] = True
        open_[before[at[before[at] >= 0]]] = True
        places = np.flatnonzero(open_ & ~gone & ~last)
        if len(cells):
            left.append((table[cells] >> np.uint64(32)).astype(np.uint32))
            right.append(table[cells].astype(np.uint32))
            rounds.append(fresh)
            fresh += len(cells)
    kept = np.flatnonzero(~gone[:n])
    empty = np.zeros(0, np.uint32)
    grammar = {"base": base, "sequence": seq[kept], "left": np.concatenate(left or [empty]), "right": np.concatenate(right or [empty]), "rounds": np.array(rounds, np.uint32)}
    grammar["expands"] = _expansions(grammar)
    # symbols per document: the documents' ends, found among the symbols kept
    closing = np.flatnonzero(last[kept]) + 1
    symbols = np.zeros(len(sizes), np.int64)
    symbols[sizes > 0] = np.diff(closing, prepend=0)
    return grammar | {"sizes": sizes.astype(np.uint32), "symbols": symbols.astype(np.uint32)}


def _slots(first: np.ndarray, second: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """Pairs as keys, their slots in a hash table, whether the slot is theirs, and the table.

    A pair that loses its slot to another one waits; the hash differs in every turn.
    """
    key = first.astype(np.uint64) << np.uint64(32) | second
    bits = max(10, min(22, len(key).bit_length() - 1))
    factor = np.uint64(0x9E3779B97F4A7C15 * (2 * turn + 1) % 2**64)
    slot = (key * factor >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.uint64)
    table[slot] = key
    return key, slot, table[slot] == key, table


def _every_other(key: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of a run of one pair, whose places overlap, every other place from the first."""
    index = np.arange(len(key))
    same = np.zeros(len(key), bool)
    same[1:] = follows & (key[1:] == key[:-1])
    if not same.any():
        return ~same
    return (index - np.maximum.accumulate(np.where(same, 0, index))) % 2 == 0


def _peaks(weight: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Places that weigh more than the places they overlap."""
    peak = weight > 0
    peak[1:] &= ~follows | (weight[1:] > weight[:-1])
    peak[:-1] &= ~follows | (weight[:-1] > weight[1:])
    return peak


def _beside(picked: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Places that overlap a picked one."""
    out = np.zeros(len(picked), bool)
    out[1:] |= follows & picked[:-1]
    out[:-1] |= follows & picked[1:]
    return out


def _expansions(g: dict) -> np.ndarray:
    """Ids behind each rule; rules only use rules of earlier rounds."""
    out = np.ones(len(g["left"]), np.uint32)
    bounds = np.append(g["rounds"], g["base"] + len(out)).astype(np.int64) - g["base"]
    for low, high in zip(bounds[:-1], bounds[1:]):
        out[low:high] = sum(_widths(g[side][low:high], out, g["base"]) for side in ("left", "right"))
    return out


def _widths(symbols: np.ndarray, expands: np.ndarray, base: int) -> np.ndarray:
    width = np.ones(len(symbols), np.uint32)
    rule = symbols >= base
    width[rule] = expands[symbols[rule].astype(np.int64) - base]
    return width


def expand(seq: np.ndarray, g: dict) -> np.ndarray:
    """Ids of a slice of symbols, undoing the rounds from the last to the first."""
    for low in g["rounds"][::-1]:
        rule = seq >= low
        if not rule.any():
            continue
        wide = np.repeat(seq, 1 + rule.astype(np.int64))
        at = np.flatnonzero(rule)
        at = at + np.arange(len(at))
        number = seq[rule].astype(np.int64) - g["base"]
        wide[at], wide[at + 1] = g["left"][number], g["right"][number]
        seq = wide
    return seq


def expand_all(g: dict) -> np.ndarray:
    """Ids of the whole shard: every rule is spelled out once, then all symbols are looked up."""
    ends = np.cumsum(g["expands"], dtype=np.int64)
    starts, spelled = ends - g["expands"], np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)

    def ids(symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= g["base"]
        width = _widths(symbols, g["expands"], g["base"]).astype(np.int64)
        begin = np.cumsum(width) - width
        source = np.zeros(len(symbols), np.int64)
        source[rule] = starts[symbols[rule].astype(np.int64) - g["base"]]
        out = np.repeat(source - begin, width) + np.arange(width.sum())
        out[begin[~rule]] = 0
        found = spelled[out] if len(spelled) else np.zeros(len(out), np.uint32)
        found[begin[~rule]] = symbols[~rule]
        return found

    bounds = np.append(g["rounds"], g["base"] + len(starts)).astype(np.int64) - g["base"]
    for low, high in zip(bounds[:-1], bounds[1:]):
        spelled[starts[low] : ends[high - 1]] = ids(np.stack([g["left"][low:high], g["right"][low:high]], axis=1).ravel())
    return ids(g["sequence"])


def decode_range(g: dict, document: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of one document; only the symbols that cover them are expanded."""
    first = int(g["symbols"][:document].sum())
    seq = g["sequence"][first : first + int(g["symbols"][document])]
    ends = np.cumsum(_widths(seq, g["expands"], g["base"]), dtype=np.int64)
    low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    before = int(ends[low - 1]) if low else 0
    return expand(seq[low : high + 1], g)[start - before : max(start, stop) - before]


def read_shard(row: dict) -> dict:
    """Arrays of a stored shard row."""
    g = {k: np.frombuffer(row[k], np.uint32) for k in ("sequence", "left", "right", "expands", "rounds", "sizes", "symbols")}
    return g | {"base": row["base"], "docs": np.frombuffer(row["docs"], np.int64)}


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int, base: int, shard_ids: int = SHARD_IDS) -> None:
    """Encodes documents in ascending doc_id order and writes their grammars as one table.

    Range partitioning spreads the documents; a task sorts its range, encodes it
    and closes a shard whenever it holds ``shard_ids`` ids. Document ids are
    stored with the largest negative number for null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        start, number = 0, 0
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int32()), *((k, pa.binary()) for k in ("docs", "sizes", "sequence", "symbols", "left", "right", "expands", "rounds"))])
        for batch in text_batches(batches):
            flat, lengths = coder.encode(batch.column("text"))
            sizes = lengths + 1
            ends = np.cumsum(sizes)
            ids = np.full(int(ends[-1]), end_id, np.int32)
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = flat
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            group = (ends - 1) // shard_ids
            for low, high in zip(*_runs(group)):
                a, b = int(ends[low] - sizes[low]), int(ends[high - 1])
                g = compress(ids[a:b], sizes[low:high], base)
                row = {"part": part, "shard": number, "start": start, "n_tokens": b - a, "base": base, "docs": docs[low:high].astype(np.int64).tobytes()}
                row |= {k: g[k].tobytes() for k in ("sizes", "sequence", "symbols", "left", "right", "expands", "rounds")}
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                start, number = start + b - a, number + 1

    null = -(2**63)
    ordered = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(path)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.flatnonzero(np.diff(group)) + 1
    return np.concatenate(([0], change)), np.concatenate((change, [len(group)]))


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents decoded from the shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; a running sum over one
    row per part carries it across parts.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = read_shard(row)
                data, sizes = expand_all(g).astype("<u4").tobytes(), g["sizes"].astype(np.int64)
                stops = np.cumsum(sizes) * 4
                checks = [zlib.crc32(data[b - n : b]) for b, n in zip(stops.tolist(), (sizes * 4).tolist())]
                columns = [np.full(len(sizes), row["part"], np.int32), g["docs"], row["start"] + np.cumsum(sizes) - sizes, sizes, np.array(checks, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = shards.mapInArrow(decode, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long").join(before, "part")
    doc = F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id")
    return rows.select(doc, (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
