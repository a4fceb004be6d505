"""Hashed 5-word shingles of many texts at once, by numpy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from tillscope.llm.common import blocks, splitmix

WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit number for each byte; capitals A-Z share that of their small letters.
_BYTE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space of the contracts."""
    return _SPACE[data]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (white space separated, A-Z lower-cased) and the byte where it starts."""
    b = np.frombuffer(text, np.uint8)
    place = np.flatnonzero(~_SPACE[b])
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate([[True], np.diff(place) > 1])
    at = np.flatnonzero(first)
    lengths = np.diff(np.append(at, len(place)))
    inside = np.arange(len(place), dtype=np.int64) - np.repeat(at, lengths)
    odd = splitmix(np.arange(int(lengths.max()), dtype=np.uint64)) | np.uint64(1)
    sums = np.add.reduceat(_BYTE[b[place]] * odd[inside], at)
    return splitmix(sums ^ lengths.astype(np.uint64)), place[at]


def shingle_sets(texts: list[bytes], size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of 1 to 4 words has one shingle."""
    for i, j in blocks(texts, size):
        part = texts[i:j]
        words, starts = word_hashes(b"\n".join(part))
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        bounds = np.searchsorted(starts, edges).tolist()
        rolled = words[:max(0, len(words) - WORDS + 1)]
        for k in range(1, WORDS):
            rolled = splitmix(rolled * _STEP + words[k:k + len(rolled)])
        for a, z in zip(bounds[:-1], bounds[1:]):
            if z - a >= WORDS:
                s = np.sort(rolled[a:z - WORDS + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif z > a:
                h = np.array([z - a], np.uint64)
                for w in words[a:z]:
                    h = splitmix(h * _STEP + w)
                yield h
            else:
                yield np.zeros(0, np.uint64)


def tag_of(shingles: np.ndarray) -> int:
    """A signed 64-bit tag of a set: equal sets have equal tags."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
