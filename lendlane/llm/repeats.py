"""Removal of repeated byte strings: anchors bring candidates together, suffix arrays find the repeats.

Equal strings of ``length`` bytes hold the same *anchor*: their leftmost smallest hashed piece.  Each
string belongs to the anchor of its place, so only neighbourhoods of anchors that occur twice can
hold repeats.  These are dealt to shards by anchor; a shard sorts the suffixes of its distinct
neighbourhoods by induced sorting, and strings with a common prefix of ``length`` with their
predecessor are runs of equal strings, of which the earliest stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import PrefixHash, save, slices, spread
from lendlane.llm.suffixes import common_prefixes, suffix_array

LENGTH = 100
PIECE = 32
PARTS = 256
PART_BITS = 18
PLACE_BITS = 26
NO_ID = (1 << 63) - 1


# ---------------------------------------------------------------- a filter in parts

def _places(values: np.ndarray) -> list[np.ndarray]:
    h, mask = spread(values), np.uint64((1 << PART_BITS) - 1)
    return [(h >> np.uint64(s)) & mask for s in (0, 18, 36)]


def _part(values: np.ndarray) -> np.ndarray:
    return (spread(values + np.uint64(77)) >> np.uint64(40)) % np.uint64(PARTS)


def _bits(values: np.ndarray) -> bytes:
    """The bits of one part that these values set."""
    bits = np.zeros(1 << PART_BITS, bool)
    for at in _places(values):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


class PartedFilter:
    """A Bloom filter of fixed size whose parts are filled by different tasks; it misses no member."""

    def __init__(self, parts: dict[int, bytes]):
        empty = bytes((1 << PART_BITS) // 8)
        self.bits = np.frombuffer(b"".join(parts.get(k, empty) for k in range(PARTS)), np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        base, found = _part(values) << np.uint64(PART_BITS), np.ones(len(values), bool)
        for at in _places(values):
            at = at + base
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _merged(parts: DataFrame) -> PartedFilter:
    """``part, data`` rows, some for the same part, as one filter: what comes to the driver is its fixed size."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(d, np.uint8) for d in rows["data"]])
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "data": [bits.tobytes()]})

    return PartedFilter({r.part: bytes(r.data) for r in parts.groupBy("part").applyInPandas(merge, "part int, data binary").collect()})


def _filter_of(values: DataFrame, column: str) -> PartedFilter:
    """A filter of the numbers in a column, gathered part by part."""
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = rows[column].to_numpy().astype(np.int64).view(np.uint64)
            part = _part(v)
            out = [(int(p), _bits(v[part == p])) for p in np.unique(part)]
            yield pd.DataFrame(out, columns=["part", "data"])

    # rows of one part come together first, so that a part is written once per task
    dealt = values.select(column, F.pmod(F.xxhash64(column), F.lit(16)).alias("_d")).repartition(16, "_d").select(column)
    return _merged(dealt.mapInPandas(fill, "part int, data binary"))


# ---------------------------------------------------------------- anchors

def _digests(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=8).digest() for r in raw), np.uint64)


class Slice:
    """The texts of a record batch as bytes in one buffer, and the anchors of their strings."""

    def __init__(self, raw: list[bytes], length: int, piece: int):
        self.raw, self.length = raw, length
        self.ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(r) for r in raw], np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.hashes = PrefixHash(self.data)
        self._piece = piece

    def signs(self) -> np.ndarray:
        """Digests that tell the texts of one id apart."""
        return _digests(self.raw)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per anchor: its hash, its text, and the first and last place of the strings it stands for."""
        n, length, piece = len(self.data), self.length, self._piece
        none = np.zeros(0, np.int64)
        if n < length:
            return np.zeros(0, np.uint64), none, none, none
        at = np.arange(n - piece + 1)
        hashes = self.hashes.of(at, at + piece)
        low, width = np.uint64((1 << PLACE_BITS) - 1), length - piece + 1
        found = []
        for lo in range(0, n - length + 1, step := (1 << PLACE_BITS) - width + 1):  # places are counted in a stretch
            part = hashes[lo:lo + step + width - 1]
            key, have = (part & ~low) | np.arange(len(part)).astype(np.uint64), 1
            while have < width:
                more = min(have, width - have)
                key = np.minimum(key[:-more], key[more:])
                have += more
            found.append((key & low).astype(np.int64) + lo)
        anchor = np.concatenate(found)  # of the string that starts here
        text = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)[:len(anchor)]
        fits = np.arange(length, len(anchor) + length) <= np.repeat(self.ends, self.ends - self.starts)[:len(anchor)]
        place = np.flatnonzero(fits)
        if not len(place):
            return np.zeros(0, np.uint64), none, none, none
        anchor, text = anchor[place], text[place]
        new = np.append(True, (np.diff(anchor) != 0) | (np.diff(text) != 0))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        return hashes[anchor[first]], text[first], place[first], place[last]


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(20)) % np.uint64(buckets)


def _shared_anchors(docs: DataFrame, firsts: PartedFilter, length: int, piece: int, buckets: int) -> PartedFilter:
    """A filter of the anchors that occur twice or more in texts of which no equal one is earlier."""
    sent = docs.sparkSession.sparkContext.broadcast(firsts)

    def emit(batches):
        for batch in slices(batches):
            own = _firsts(batch, sent.value)
            hashes = Slice(own[1], length, piece).anchors()[0]
            part = _part(hashes).astype(np.int64) * buckets + _dealt(hashes, buckets).astype(np.int64)
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            pieces = np.split(hashes[order], starts[1:]) if len(values) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(values // buckets, pa.int32()), pa.array(values % buckets, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["part", "bucket", "data"])

    def twice(rows: pd.DataFrame) -> pd.DataFrame:
        values, n = np.unique(np.frombuffer(b"".join(rows["data"]), "<u8"), return_counts=True)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "data": [_bits(values[n > 1])]})

    found = docs.mapInArrow(emit, "part int, bucket int, data binary").groupBy("part", "bucket").applyInPandas(twice, "part int, data binary")
    return _merged(found)


def _firsts(batch: pa.RecordBatch, firsts: PartedFilter) -> tuple[np.ndarray, list[bytes]]:
    """Ids and bytes of the texts of a batch that may be the earliest of their kind."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = _raw(batch)
    keep = np.flatnonzero(firsts.has(ids.view(np.uint64)))
    return ids[keep], [raw[i] for i in keep]


# ---------------------------------------------------------------- shards

CONTEXTS = "bucket int, anchor long, doc long, sign long, start int, strings int, data binary"
FOUND = "doc long, sign long, lo int, hi int"


def _contexts(docs: DataFrame, firsts: PartedFilter, shared: PartedFilter, length: int, piece: int, buckets: int) -> DataFrame:
    """The neighbourhoods of shared anchors: all bytes of the strings an anchor stands for.

    A task sends equal neighbourhoods once, as long as the first it met is the earliest.  A later one
    is known to be repeated: it goes without its bytes, to any shard.
    """
    sent = docs.sparkSession.sparkContext.broadcast((firsts, shared))

    def emit(batches):
        first_filter, shared_filter = sent.value
        earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
        for batch in slices(batches):
            ids, raw = _firsts(batch, first_filter)
            own = Slice(raw, length, piece)
            hashes, text, first, last = own.anchors()
            keep = np.flatnonzero(shared_filter.has(hashes)) if len(hashes) else np.zeros(0, np.int64)
            hashes, text, first, last = hashes[keep], text[keep], first[keep], last[keep]
            if not len(hashes):
                continue
            signs, buffer, doc, start = own.signs(), own.data.tobytes(), ids[text], first - own.starts[text]
            bucket = _dealt(hashes, buckets).astype(np.int64)
            anywhere = (spread(doc.view(np.uint64) + spread(start.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            data = []
            for i, place in enumerate(zip(hashes.tolist(), doc.tolist(), start.tolist(), first.tolist(), last.tolist())):
                piece_bytes, here = buffer[place[3]:place[4] + length], place[1:3]
                content = place[0], hashlib.blake2b(piece_bytes, digest_size=16).digest()
                known = earliest.get(content)
                if known is not None and known < here:
                    data.append(None)
                    bucket[i] = anywhere[i]
                else:
                    earliest[content] = here
                    data.append(piece_bytes)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(doc), pa.array(signs[text].view(np.int64)),
                pa.array(start.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(data, pa.binary()),
            ], ["bucket", "anchor", "doc", "sign", "start", "strings", "data"])

    return docs.mapInArrow(emit, CONTEXTS)


def repeated_strings(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Ranges of bytes covered by strings that start earlier too, in the neighbourhoods of one shard."""
    known, rows = rows[rows["data"].isna()], rows[rows["data"].notna()]  # the first are known to be repeated
    rows = rows.sort_values(["doc", "start", "sign"], kind="stable").drop_duplicates(["doc", "start", "sign", "anchor"]).reset_index(drop=True)
    again = rows.duplicated(["anchor", "data"])
    copies, rows = pd.concat([known, rows[again]]), rows[~again]
    several = rows.groupby("anchor")["doc"].transform("size") > 1
    rows = rows[several].reset_index(drop=True)
    out = [pd.DataFrame({"doc": copies["doc"], "sign": copies["sign"], "lo": copies["start"], "hi": copies["start"] + copies["strings"] + length - 1})]
    # equal strings share an anchor, so anchors may be sorted in portions
    for _, portion in rows.groupby((rows.groupby("anchor").ngroup() // 4096) if len(rows) else []):
        out.append(_sorted(portion.reset_index(drop=True), length))
    return pd.concat(out, ignore_index=True)


def _sorted(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    joined = b"".join(d + b"\0" for d in rows["data"])
    data = np.frombuffer(joined, np.uint8)
    sizes = rows["data"].map(len).to_numpy() + 1
    base = np.cumsum(sizes) - sizes
    order = suffix_array(data, 2 * length)
    row = np.searchsorted(base, order, side="right") - 1
    offset = order - base[row]
    valid = offset < rows["strings"].to_numpy()[row]
    shared = common_prefixes(data, order, length)[order]
    # a run of suffixes that share the length: its number counts the breaks before it
    run = np.cumsum(shared < length)[valid]
    row, offset = row[valid], offset[valid]
    start = rows["start"].to_numpy()[row] + offset
    rank = row.astype(np.int64)  # rows stand by document and start
    # rows are sorted by document, and start; the order of two strings is that of (document, start)
    document = rows["doc"].to_numpy()[row]
    by = np.lexsort((start, document, run))
    run, row, start, document = run[by], row[by], start[by], document[by]
    later = np.append(False, (run[1:] == run[:-1])) if len(run) else np.zeros(0, bool)
    # equal places of one document, seen from two neighbourhoods, are one
    first = np.maximum.accumulate(np.where(~later, np.arange(len(run)), 0)) if len(run) else rank
    later &= ~((document == document[first]) & (start == start[first]))
    return pd.DataFrame({"doc": document[later], "sign": rows["sign"].to_numpy()[row[later]], "lo": start[later], "hi": start[later] + length})


def _united(rows: pd.DataFrame) -> pd.DataFrame:
    """The ranges of a shard, joined where they touch."""
    if not len(rows):
        return rows
    rows = rows.sort_values(["doc", "sign", "lo"], kind="stable")
    doc, sign, lo, hi = (rows[c].to_numpy() for c in ("doc", "sign", "lo", "hi"))
    new = np.append(True, (doc[1:] != doc[:-1]) | (sign[1:] != sign[:-1]))
    group = np.cumsum(new)
    reach = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return pd.DataFrame({"doc": doc[first], "sign": sign[first], "lo": lo[first], "hi": reach[last]})


# ---------------------------------------------------------------- the operator

def without_repeats(docs: DataFrame, ids: str = "doc_id", length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (``ids``, ``text``).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, by id and then
    place; matches do not cross texts.  NULL texts are empty.  Rows without an id come last of all.
    Equal rows are one document with equal results; of equal texts the smallest id is the earliest.
    """
    docs = docs.select(F.coalesce(F.col(ids).cast("long"), F.lit(NO_ID)).alias("doc"), "text")

    def describe(batches):
        for batch in slices(batches):
            raw = _raw(batch)
            signs = _digests(raw).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(signs, pa.int64()), pa.array([len(r) for r in raw], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())], ["doc", "sign", "n_bytes", "whole"])

    rows = save(docs.mapInArrow(describe, "doc long, sign long, n_bytes long, whole string"), "texts")
    first = save(rows.groupBy("whole").agg(F.min("doc").alias("first")), "firsts")
    firsts = _filter_of(first.select("first"), "first")
    n = rows.count()
    shared = _shared_anchors(docs, firsts, length, piece, 1 + n // 250_000)
    shards = max(64, n // 500)
    found = _contexts(docs, firsts, shared, length, piece, shards).groupBy("bucket").applyInPandas(
        lambda part: _united(repeated_strings(part, length)), FOUND)
    ranges = found.groupBy("doc", "sign").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    ranges = save(ranges, "ranges")

    touched = docs.sparkSession.sparkContext.broadcast(_filter_of(ranges.select("doc").distinct(), "doc"))

    def touched_only(batches):
        for batch in slices(batches):
            doc = batch.column(0).to_numpy().view(np.uint64)
            keep = np.flatnonzero(touched.value.has(doc))
            part = batch.take(pa.array(keep))
            signs = _digests(_raw(part)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signs, pa.int64())], ["doc", "text", "sign"])

    def cut(batches):
        for batch in slices(batches):
            out = [_cut(t.encode(), r) for t, r in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["doc", "sign", "n_removed", "n_spans", "kept"])

    texts_of = docs.mapInArrow(touched_only, "doc long, text string, sign long")
    done = ranges.join(texts_of, ["doc", "sign"]).select("doc", "sign", "ranges", "text").mapInArrow(
        cut, "doc long, sign long, n_removed long, n_spans long, kept string")
    done = save(done.dropDuplicates(["doc", "sign"]), "cut")

    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length)
    out = rows.join(first, "whole").join(done, ["doc", "sign"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))


def _cut(raw: bytes, ranges: list[dict]) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs, and the digest of what is left."""
    kept, at, spans, removed = [], 0, 0, 0
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if lo > at or not spans:
            kept.append(raw[at:lo])
            spans += 1
            removed += hi - lo
            at = hi
        elif hi > at:
            removed += hi - at
            at = hi
    kept.append(raw[at:])
    return removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()
