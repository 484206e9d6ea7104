"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified by whether they are smaller than the next one; the leftmost smaller ones
are sorted by their substrings, recursively on names, and induce the order of all others in two
scans.  The scans go bucket by bucket, so each step handles many suffixes at once.
"""

from __future__ import annotations

import numpy as np

from lendlane.llm.shared import PrefixHash

PORTION = 100_000
SMALL_ALPHABET = 1024


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` in order of their first ``depth`` symbols at least."""
    text = np.append(np.asarray(text, np.int64) + 1, 0)  # a smallest last symbol
    return _induced(text, int(text.max()) + 1, depth)[1:]


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts after it."""
    n = len(text)
    step = np.sign(np.diff(text))
    decided = np.where(step != 0, np.arange(n - 1), n)
    where = np.minimum.accumulate(decided[::-1])[::-1]
    out = np.ones(n, bool)
    known = where < n
    out[:-1][known] = step[where[known]] > 0
    return out


def _induced(text: np.ndarray, alphabet: int, depth: int) -> np.ndarray:
    if len(text) < 3:
        return np.argsort(text, kind="stable")
    smaller = _smaller(text)
    least = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = _scan(text, smaller, least[np.argsort(text[least], kind="stable")], alphabet)
    is_least = np.zeros(len(text), bool)
    is_least[least] = True
    ordered = rough[is_least[rough]]
    names = _names(text, smaller, least, ordered)
    if names.max() + 1 < len(least):
        if names.max() < SMALL_ALPHABET and depth > 4:
            order = _induced(np.append(names + 1, 0), int(names.max()) + 2, depth // 2)[1:]
        else:
            order = _doubled(names, depth // 2 + 1)
        ordered = least[order]
    return _scan(text, smaller, ordered, alphabet)


def _names(text, smaller, least, ordered) -> np.ndarray:
    """Names of the substrings between leftmost smaller suffixes, equal for equal ones, in order."""
    end = np.empty(len(text), np.int64)
    end[least] = np.append(least[1:], len(text) - 1)
    a, b = ordered[:-1], ordered[1:]
    same = (end[a] - a) == (end[b] - b)
    live, k = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = text[x] == text[y]
        same[live[~equal]] = False
        live = live[equal & (x < end[a[live]])]
        k += 1
    name = np.empty(len(text), np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    return name[least]


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling the ranked length."""
    rank, length = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-length or None] = rank[length:] + 1 if length < len(rank) else 0
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank = np.empty_like(rank)
        rank[order] = fresh
        length *= 2
        if fresh[-1] + 1 == len(rank) or length >= depth:
            return order


def _scan(text, smaller, ordered, alphabet: int) -> np.ndarray:
    """Induce all suffixes from the ordered leftmost smaller ones: larger ones up, then smaller ones down."""
    # symbols of the suffixes to place, in the narrowest type, which sorts fastest; all others, and the last one, are none
    narrow = np.min_scalar_type(alphabet)
    to_larger, to_smaller = np.where(smaller, alphabet, text).astype(narrow), np.where(smaller, text, alphabet).astype(narrow)
    to_larger[-1] = to_smaller[-1] = alphabet
    starts = np.searchsorted(text[ordered], np.arange(alphabet + 1)).tolist()
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    for c in range(alphabet):
        _follow(to_larger, alphabet, c, larger)
        _before(to_larger, alphabet, ordered[starts[c]:starts[c + 1]], larger)
    up = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in larger]
    down: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    for c in range(alphabet - 1, -1, -1):
        _follow(to_smaller, alphabet, c, down)
        _before(to_smaller, alphabet, up[c][::-1], down)
    out = []
    last = np.array([len(text) - 1])
    for c in range(alphabet):
        out.append(up[c])
        out += [x[::-1] for x in down[c][::-1]]
    return np.concatenate([last, *out])


def _follow(symbols, none: int, c: int, into) -> None:
    """Go on from a whole bucket at once, and from what that adds to it, while runs of its symbol are followed."""
    at = 0
    while at < len(into[c]):
        part, at = into[c][at:], len(into[c])
        _before(symbols, none, np.concatenate(part) if len(part) > 1 else part[0], into)


def _before(symbols, none: int, at, into) -> None:
    """Put the suffixes one symbol longer, if that symbol is not none, into the buckets of their symbols, in order."""
    if not len(at):
        return
    at = at - 1  # before the first suffix comes the last one, which is none
    own = symbols[at]
    kept = own != none
    own, at = own[kept], at[kept]
    if not len(at):
        return
    order = own.argsort(kind="stable")
    own, at = own[order], at[order]
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(at)]
    for c, lo, hi in zip(own[cuts[:-1]].tolist(), cuts, cuts[1:]):
        into[c].append(at[lo:hi])


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each place the length it shares with its predecessor in order, ``most`` at most.

    ``most`` is never wrong: it is told from less by the bytes themselves.
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    hashes, n = PrefixHash(data), len(data)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    room = np.minimum(most, n - np.maximum(at, other))
    low, high = np.zeros(len(at), np.int64), room
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(at, at + middle) == hashes.of(other, other + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    # what the hashes call equal throughout is compared byte by byte
    whole = np.flatnonzero(low == most)
    for part in np.split(whole, range(PORTION, len(whole), PORTION)):
        step = np.arange(most)
        differs = data[at[part, None] + step] != data[other[part, None] + step]
        wrong = differs.any(axis=1)
        low[part[wrong]] = differs[wrong].argmax(axis=1)
    out = np.zeros(n, np.int64)
    out[at] = low
    return out
