"""Banded bit-parallel edit distance for many pairs of strings at once.

Of the dynamic programme only the 2k+1 diagonals around the main one matter. A
byte per pair and error count holds which of them are reachable, bit d - k for
the diagonal d; one pass over the columns updates all pairs with a few bit
operations, so Python's cost is shared by the whole batch.
"""

from __future__ import annotations

import numpy as np

CELLS = 4_000_000


def within(left: list[str], right: list[str], k: int) -> np.ndarray:
    """Whether each pair is within edit distance k (0 to 3)."""
    if not 0 <= k <= 3:
        raise ValueError("the band of 2k+1 diagonals must fit a byte")
    size_l, size_r = np.fromiter(map(len, left), np.int64, len(left)), np.fromiter(map(len, right), np.int64, len(right))
    out = np.zeros(len(left), bool)
    order = np.flatnonzero(np.abs(size_l - size_r) <= k)
    order = order[np.argsort(-size_r[order], kind="stable")]
    low = 0
    while low < len(order):
        longest = int(max(size_r[order[low]], 1))
        some = order[low : low + max(1, CELLS // longest)]
        out[some] = _batch([left[i] for i in some], [right[i] for i in some], size_l[some], size_r[some], k)
        low += len(some)
    return out


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points, one row per text, padded to the width."""
    out = np.full((len(texts), width), fill, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.repeat(np.arange(len(texts)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _batch(left: list[str], right: list[str], size_l: np.ndarray, size_r: np.ndarray, k: int) -> np.ndarray:
    """Pairs with ``right`` from the longest to the shortest."""
    width = int(size_r.max(initial=0))
    text = _codes(right, width, -1)
    pattern = np.pad(_codes(left, width + k, -2), ((0, 0), (k, 0)), constant_values=-2)
    match = np.zeros((width, len(left)), np.uint8)
    for bit in range(2 * k + 1):
        match |= ((pattern[:, bit : bit + width] == text).T.astype(np.uint8)) << np.uint8(bit)
    full = np.uint8((1 << (2 * k + 1)) - 1)
    reach = [np.full(len(left), ((1 << (e + 1)) - 1) << k & int(full), np.uint8) for e in range(k + 1)]
    for j in range(width):
        active = int(np.searchsorted(-size_r, -j, side="left"))  # texts longer than j
        m = match[j, :active]
        before, new_before = None, None
        for e in range(k + 1):
            old = reach[e][:active].copy()
            new = old & m
            if e:
                # a changed or an inserted character, or one left out
                new |= before | (before >> np.uint8(1)) | (new_before << np.uint8(1))
                new &= full
            reach[e][:active] = new
            before, new_before = old, new
    end = (size_l - size_r + k).astype(np.uint8)
    return (reach[k] >> end & np.uint8(1)).astype(bool)
