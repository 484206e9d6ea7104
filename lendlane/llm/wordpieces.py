"""Token ids of texts, one distinct unit of their words at a time.

The word tokenizer drops white space and its splits never reach over it, so the ids of a text
are those of its words in a row.  It folds case, and a run of letters is one of its units, as are ASCII marks after it
up to the word's end; but special strings, which begin with ``<|``, are only known in the case they are written in,
so words that hold that beginning stay as they are.  Each worker keeps the ids of units it has met, up to a bound,
for all its tasks.
"""

from __future__ import annotations

import functools
import os
import string
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 500_000
BATCH = 1_000
SPECIAL = b"<|"  # fixed value: how special strings begin


def _letters(tokenizer) -> str:
    """A pattern of words in letters that the tokenizer's normal form leaves as they are and its split keeps together.

    Letters from U+2000 on, and those of Hangul that compose with each other, go through the whole tokenizer.
    """
    def stays(c: str) -> bool:
        return tokenizer.normalizer.normalize_str(c) == c and len(tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1

    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return "^[^\\x00-\\x{10FFFF}]$"  # none
    own = [c for c in map(chr, range(0x2000)) if c.isalpha() and not "ᄀ" <= c < "ሀ" and stays(c)]
    return f"^[{''.join(own)}]+$"


def _taken(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` of ``ids`` from each ``begin``, in a row."""
    ends = np.cumsum(size)
    return ids[np.repeat(begin - (ends - size), size) + np.arange(len(size) and ends[-1])]


def _halves(words: pa.LargeStringArray, letters: str) -> pa.LargeStringArray:
    """Two units of each word: letters and the marks after them; else the word and an empty one."""
    stems = pc.ascii_rtrim(words, characters=string.punctuation)
    plain = pc.match_substring_regex(stems, letters).to_numpy(zero_copy_only=False)
    begin = np.append(0, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)))
    cut = np.where(plain, begin[:-1] + pc.binary_length(stems).to_numpy(zero_copy_only=False), begin[1:])
    offsets = np.append(np.column_stack([begin[:-1], cut]).ravel(), begin[-1]).astype(np.int64)
    text = b"".join(words.cast(pa.large_binary()).to_numpy(zero_copy_only=False))
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(offsets), pa.py_buffer(text))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit numbers.

    Of units kept from earlier calls, only those met again are still kept when they and the new ones are too many.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    letters = _letters(tokenizer)
    # the same model for letters alone, which need neither normal form nor split
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    last = np.zeros(max(tokenizer.get_vocab().values(), default=0) + 1, bool)
    last[[i for t, i in bare.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    # number of each unit; its ids are those from its end to that of the next
    known, ids, ends = {"": 0}, np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def of_letters(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number for each part: parts are encoded as one text, where the ids that end one are known."""
        found = np.array(bare.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(last[found]) + 1
        if len(stops) != len(parts) or stops[-1] != len(found):
            return of_others(parts)
        return found, np.diff(stops, prepend=0)

    def of_others(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for f in found for i in f], "<u4"), np.array([len(f) for f in found], np.int64)

    def learn(names: list[str], encoded: Callable) -> np.ndarray:
        nonlocal ids, ends
        number = np.arange(len(known), len(known) + len(names))
        found = [encoded(names[i:i + BATCH]) for i in range(0, len(names), BATCH)]
        if found:
            known.update(zip(names, number.tolist()))
            ids = np.concatenate([ids, *(f for f, _ in found)])
            ends = np.append(ends, ends[-1] + np.cumsum(np.concatenate([n for _, n in found])))
        return number

    def keep(names: list[str]) -> None:
        """Of known units, only these and the empty one stay known."""
        nonlocal known, ids, ends
        names = [n for n in names if n]
        own = np.array([known[n] for n in names], np.int64)
        sizes = ends[own + 1] - ends[own]
        known = {n: i for i, n in enumerate(["", *names])}
        ids, ends = _taken(ids, ends[own], sizes), np.append([0, 0], np.cumsum(sizes))

    def numbers(units: pa.LargeStringArray) -> np.ndarray:
        names = units.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        new = number < 0
        if len(known) + new.sum() > MOST_WORDS:
            keep(names[~new].tolist())
            number = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        plain = pc.match_substring_regex(units, letters).to_numpy(zero_copy_only=False)
        number[new & plain] = learn(names[new & plain].tolist(), of_letters)
        number[new & ~plain] = learn(names[new & ~plain].tolist(), of_others)
        return number

    def normal(text: bytes) -> bytes:
        if SPECIAL not in text:
            return text.lower()  # ASCII case only
        return b" ".join(w if SPECIAL in w else w.lower() for w in text.split())

    def encode(texts: list[str]) -> list[bytes]:
        parts = pa.array([normal(t.encode("utf-8", "replace")) for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
        own = pc.ascii_split_whitespace(parts)  # the white space that bytes are split at; may leave empty words
        coded = own.flatten().dictionary_encode()
        halves = _halves(coded.dictionary, letters).dictionary_encode()
        unit = numbers(halves.dictionary)[halves.indices.to_numpy(zero_copy_only=False)]
        # the ids of distinct words, then of all words in a row
        sizes = ends[unit + 1] - ends[unit]
        of_words, sizes = _taken(ids, ends[unit], sizes), sizes.reshape(-1, 2).sum(axis=1)
        word = coded.indices.to_numpy(zero_copy_only=False)
        data = _taken(of_words, (np.cumsum(sizes) - sizes)[word], sizes[word])
        cuts = np.append(0, np.cumsum(sizes[word]))[own.offsets.to_numpy()].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    return encode
