"""Distinct word shingles of texts as sorted 64-bit hashes, a slice of texts at a time."""

from __future__ import annotations

import numpy as np

from lendlane.llm.shared import spread, word_hashes, word_ranges

WIDTH = 5
#: Bytes of text to take at a time: what is made of them stays in a core's caches.
AT_ONCE = 1_000_000
_STEP = 0xC2B2AE3D27D4EB4F


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for short arrays costs much less than ``np.unique``."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values if new.all() else values[new]


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words, A-Z lower-cased.

    A text with fewer words has one, of all its words; a text without words has none.
    """
    parts = [t.encode("utf-8", "replace").lower() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    start, end = word_ranges(data)
    words = word_hashes(data, start, end)
    cuts = [0, *np.searchsorted(start, ends).tolist()]
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled += words[k:len(words) - width + 1 + k] * np.uint64(pow(_STEP, k, 1 << 64))
    rolled = spread(rolled + np.uint64(width))
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo >= width:
            out.append(_distinct(rolled[lo:hi - width + 1]))
        elif hi > lo:
            factors = np.array([pow(_STEP, k, 1 << 64) for k in range(hi - lo)], np.uint64)
            out.append(spread(np.array([(words[lo:hi] * factors).sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> list[int]:
    """One signed 64-bit number for each set of hashes; equal sets have equal numbers."""
    sizes = np.array([len(s) for s in sets], np.int64)
    filled = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[filled]
    hashes = np.concatenate([np.zeros(0, np.uint64), *sets])

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.uint64)
        if len(filled):
            out[filled] = np.add.reduceat(spread(values), begins)
        return out

    a, b = sums(hashes ^ np.uint64(0x1234567)), sums(hashes + np.uint64(0x89ABCDEF))
    return spread(a ^ spread(b + sizes.astype(np.uint64))).view(np.int64).tolist()


def signature(hashes: np.ndarray) -> int:
    """The number of one set."""
    return signatures([hashes])[0]
