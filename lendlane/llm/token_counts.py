"""Token counts of whole texts with a byte-level tokenizer, huge texts in overlapping chunks.

A space with a non-space on either side starts a token whatever stands around it: every
alternative of the tokenizer's split takes white space at its beginning only, and special strings
hold none.  Such places are *stable*.  Chunks of a huge text are spliced at a stable place where
both encodings have a token start; if their overlap has none, it is widened.  Other texts are
counted unit by unit between stable places, and each task remembers the counts of short units.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import slices, texts

CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024
MOST_UNITS = 300_000
LONG_UNIT = 64
_STABLE = re.compile(r"(?<=\S) (?=\S)")
_UNITS = re.compile(r"(?<=\S)(?= \S)")
_DOUBLE = re.compile(r"\s\s")


class Counter:
    """Counts the tokens of texts as the library does, in one task."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._chunk, self._overlap = chunk, overlap
        self._known: dict[str, int] = {}  # counts of units without their leading space

    def count(self, text: str) -> int:
        return self._spliced(text) if len(text) > self._chunk else self._by_units(text)

    def _by_units(self, text: str) -> int:
        if not text:
            return 0
        if text[0].isspace() or text[-1].isspace() or _DOUBLE.search(text):
            first, *rest = _UNITS.split(text)
            rest = [u[1:] for u in rest]
        else:  # each space is a stable place
            first, *rest = text.split(" ")
        missing = list(set(rest).difference(self._known))
        extra = {}
        if missing:
            if len(self._known) + len(missing) > MOST_UNITS:
                self._known.clear()
                missing = list(set(rest))
            for i in range(0, len(missing), 1000):
                part = missing[i:i + 1000]
                for unit, found in zip(part, self._encode([" " + u for u in part])):
                    (self._known if len(unit) <= LONG_UNIT else extra)[unit] = len(found.ids)
        known = self._known
        many = sum(known[u] if u in known else extra[u] for u in rest) if extra else sum(map(known.__getitem__, rest))
        return many + len(self._encode([first])[0].ids)

    def _encode(self, parts: list[str]):
        return self._tokenizer.encode_batch(parts, add_special_tokens=False)

    def _spliced(self, text: str) -> int:
        """Encode overlapping chunks with offsets and cut each where the next one takes over."""
        total, start, done = 0, 0, 0  # tokens that begin before ``done`` are counted
        while True:
            end = min(len(text), start + self._chunk)
            begins = self._begins(text, start, end)
            if end == len(text):
                return total + sum(b >= done for b in begins)
            overlap, place = self._overlap, None
            while place is None:
                following = max(end - overlap, start + 1)
                reach = min(len(text), end + overlap)
                # the next chunk must know the place too: both encodings begin a token there
                shared = {b for b in begins if b > following}
                if shared:
                    ahead = set(self._begins(text, following, reach))
                    stable = [m.start() for m in _STABLE.finditer(text, following + 1, max(end - 1, following + 1))]
                    place = next((p for p in reversed(stable) if p > done and p in shared and p in ahead), None)
                if place is None:
                    if end == len(text):
                        return total + sum(b >= done for b in begins)
                    overlap *= 2
                    end = min(len(text), end + overlap)
                    begins = self._begins(text, start, end)
            total += sum(done <= b < place for b in begins)
            start = done = place

    def _begins(self, text: str, start: int, end: int) -> list[int]:
        """Where the tokens of a chunk begin; tokens inside one character share its place."""
        return [start + a for a, _ in self._encode([text[start:end]])[0].offsets]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; NULL texts are empty and have no tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches):
            own = texts(batch)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode()) for t in own], pa.int64()), pa.array([counter.count(t) for t in own], pa.int64()),
            ], schema=schema)

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
