"""Static binary-fuse filters over 64-bit keys, in numpy.

Each key has three slots in neighbouring segments of a table of fingerprints, and
its fingerprint is the exclusive or of the three. The table is filled by peeling:
slots that only one key uses are taken round by round, all slots of a round at
once, and filled in reverse order. A filter knows all its keys and takes one in
2**8 of the others for its own; it takes about 1.13 bytes a key and never changes.
"""

from __future__ import annotations

import math

import numpy as np

SEEDS = 200
STEPS = tuple(np.uint64(c) for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for step in STEPS:
        h = (h ^ (h >> np.uint64(33))) * step
    return h ^ (h >> np.uint64(33))


def shape(n: int) -> tuple[int, int]:
    """(length of a segment, a power of two; number of segments a key may start in) for n keys."""
    if n < 2:
        return 4, 1
    length = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
    slots = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(slots / length) - 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three rows of slots, one in each of three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    inside = [(h >> np.uint64(shift)) & np.uint64(length - 1) for shift in (0, 18, 36)]
    # the third takes bits that also chose the segment; a multiplication spreads them anew
    inside[2] = (h * STEPS[0] >> np.uint64(40)) & np.uint64(length - 1)
    return np.stack([(first + np.uint64(i)) * np.uint64(length) + inside[i] for i in range(3)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> dict:
    """Filter of the keys; repeated ones count once."""
    keys = np.unique(keys)
    length, segments = shape(len(keys))
    for seed in range(SEEDS):
        h = _mixed(keys, seed)
        slots = _slots(h, length, segments)
        order = _peel(slots, (segments + 2) * length)
        if order is not None:
            return {"seed": seed, "length": length, "segments": segments, "prints": _fill(order, slots, _prints(h), (segments + 2) * length).tobytes()}
    raise ValueError("no seed gave a filter")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own slots) in which every key is taken once, or None if some never stand alone."""
    users = np.bincount(slots.ravel(), minlength=size)
    mark = np.zeros(size, np.int64)
    numbers = np.arange(slots.shape[1])
    for row in slots:
        np.bitwise_xor.at(mark, row, numbers)
    rounds, taken = [], 0
    alone = np.flatnonzero(users == 1)
    while len(alone):
        keys, at = np.unique(mark[alone], return_index=True)
        rounds.append((keys, alone[at]))
        taken += len(keys)
        touched = slots[:, keys]
        for row in touched:
            np.subtract.at(users, row, 1)
            np.bitwise_xor.at(mark, row, keys)
        touched = np.unique(touched)
        alone = touched[users[touched] == 1]
    return rounds if taken == slots.shape[1] else None


def _fill(rounds: list, slots: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
    table = np.zeros(size, np.uint8)
    for keys, own in reversed(rounds):
        # the own slot still holds zero, so it does not disturb the sum
        a, b, c = slots[:, keys]
        table[own] = prints[keys] ^ table[a] ^ table[b] ^ table[c]
    return table


def contains(f: dict, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter takes for its own: all that are, and few others."""
    h = _mixed(keys, f["seed"])
    a, b, c = _slots(h, f["length"], f["segments"])
    table = np.frombuffer(f["prints"], np.uint8)
    return table[a] ^ table[b] ^ table[c] == _prints(h)
