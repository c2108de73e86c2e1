"""A Bloom filter of fixed size over many keys, to leave out rows before a shuffle.

Each task marks its keys in a bit array, the arrays are joined by bytewise or per
range, and the result (2**BITS bits, whatever the number of keys) is sent to the
tasks. It lets all keys through and few others; what it lets through is joined
exactly afterwards, so its rate of errors costs speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, RANGE_BITS, HASHES = 25, 4, 3


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """Bit numbers of 64-bit keys, from two mixes of the key."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step = (h * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return [((h + np.uint64(i) * step) >> np.uint64(64 - BITS)).astype(np.int64) for i in range(HASHES)]


def build(keys: DataFrame) -> np.ndarray:
    """Bits of the only column of ``keys``, 64-bit numbers without nulls."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for places in _places(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)):
                bits[places] = True
        packed = np.packbits(bits).reshape(1 << RANGE_BITS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], ["part", "bits"])

    def merge(rows: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
        return pa.table([rows.column("part").slice(0, 1), pa.array([joined.tobytes()], pa.binary())], names=["part", "bits"])

    parts = keys.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect()
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(parts)), np.uint8) if parts else np.zeros((1 << BITS) // 8, np.uint8)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the filter."""
    out = np.ones(len(keys), bool)
    for places in _places(np.ascontiguousarray(keys, np.int64).view(np.uint64)):
        out &= (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
    return out


def matching(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key, a 64-bit number, may be among the only column of ``keys``; neither holds nulls."""
    bits = rows.sparkSession.sparkContext.broadcast(build(keys))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(key).to_numpy())))

    return rows.mapInArrow(sift, rows.schema)
