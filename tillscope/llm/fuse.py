"""Static binary-fuse filters (three 8-bit cells per key, about 1.13 to 1.3 bytes a key), built by numpy.

The construction follows the published algorithm (Graf and Lemire, 2022): each
key has one cell in three consecutive segments; keys with a cell of their own
are peeled off, round by round, and cells are set in reverse order so that the
xor of a key's cells is its fingerprint. No key of the set is ever missed.
"""

from __future__ import annotations

import math

import numpy as np

from tillscope.llm.common import splitmix


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments a key may start in."""
    segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return segment, max(1, -(-int(n * factor) // segment) - 2)


def _cells(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, and its fingerprint."""
    h = splitmix(keys ^ splitmix(np.array([seed], np.uint64)))
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    g, mask = splitmix(h), np.uint64(segment - 1)
    cells = np.stack([(first + np.uint64(k)) * np.uint64(segment) + ((g >> np.uint64(20 * k)) & mask)
                      for k in range(3)]).astype(np.int64)
    return cells, ((h ^ (h >> np.uint64(8))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, start segments and cells of a filter for distinct 64-bit keys."""
    keys = np.unique(np.asarray(keys, np.uint64))
    segment, starts = _shape(len(keys))
    size = (starts + 2) * segment
    for seed in range(1000):
        cells, prints = _cells(keys, seed, segment, starts)
        number = np.arange(len(keys), dtype=np.int64)
        count = np.bincount(cells.ravel(), minlength=size)
        mixed = np.zeros(size, np.int64)
        for k in range(3):
            np.bitwise_xor.at(mixed, cells[k], number)
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            peeled, at = np.unique(mixed[alone], return_index=True)
            rounds.append((peeled, alone[at]))
            for k in range(3):
                np.subtract.at(count, cells[k][peeled], 1)
                np.bitwise_xor.at(mixed, cells[k][peeled], peeled)
            left -= len(peeled)
        if not left:
            table = np.zeros(size, np.uint8)
            for peeled, at in reversed(rounds):
                table[at] = 0
                c = cells[:, peeled]
                table[at] = prints[peeled] ^ table[c[0]] ^ table[c[1]] ^ table[c[2]]
            return seed, segment, starts, table.tobytes()
    raise ValueError("no seed gives a filter")  # chance below 1e-300 for distinct keys


def contains(keys: np.ndarray, seed: int, segment: int, starts: int, table: bytes) -> np.ndarray:
    """True for every key of the set, and for about 1 in 256 others."""
    cells, prints = _cells(np.asarray(keys, np.uint64), seed, segment, starts)
    t = np.frombuffer(table, np.uint8)
    return (t[cells[0]] ^ t[cells[1]] ^ t[cells[2]]) == prints
