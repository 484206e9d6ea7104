"""N-gram Jaccard join: a size-aware heavy-light set join, exact, and the groups its links make.

Equal sets are one class.  *Light* sets, small ones, list their subsets of the size a partner
must share; sets that list the same subset are linked, nothing is left to verify.  *Heavy* sets
put the rarest of their elements into inverted lists; sets that meet in a list are candidates and
are verified on whole sets.  The boundary comes from the cost of both on the histogram of sizes.

A list with many sets is not expanded to all pairs.  Each set is first compared with the centre
of its lists, then with the set of its lists that meets the most others; what that links is one
group.  In the end sets that meet in a list and are still in different groups are compared by sketches, tile by
tile, and only pairs that sketches leave possible are verified.  No link between groups is lost this way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import components, free_names, quoted, save, slices, spread, texts
from lendlane.llm.shingles import AT_ONCE, shingle_sets, signatures

PERCENT = 80
LARGEST_LIGHT = 24
FREQUENT = 8
FILTER_BITS = 25
MOST_FREQUENT = 1_000_000
BLOCKS = 32
SKETCH_BITS = 1024
CHUNK = 1024
NEIGHBOURS = 15


def required(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many elements, in one common order, must go into lists."""
    return n - -(-percent * n // 100) + 1


def _partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The largest size of a light set, by the number of entries both ways would make.

    A heavy set makes its prefix and, to be verified, about half of its elements again.  Sets
    just below the boundary have heavy partners and pay for both.
    """
    def cost(light: int) -> float:
        total = 0.0
        for n, count in histogram.items():
            if n <= light:
                total += count * sum(math.comb(n, required(n, b, percent)) for b in _partners(n, percent) if b <= light)
            if 100 * n >= percent * (light + 1):
                total += count * (prefix(n, percent) + n / 2)
        return total

    return min(range(LARGEST_LIGHT + 1), key=lambda light: (cost(light), light))


# ---------------------------------------------------------------- a bounded filter

class BitFilter:
    """A fixed-size Bloom filter: never misses a member; what it wrongly admits costs time only."""

    def __init__(self, values: np.ndarray, bits: int = FILTER_BITS):
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        self._shift = bits
        for at in self._places(values):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def _places(self, values: np.ndarray):
        h, mask = spread(values.astype(np.uint64)), np.uint64((1 << self._shift) - 1)
        return [h & mask, (h >> np.uint64(20)) & mask, (h >> np.uint64(39)) & mask]

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for at in self._places(values):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Sets of slices of texts; a set the task has met before is left out."""
    met = set()
    for batch in slices(batches, most=AT_ONCE):
        signs, sets = [], []
        found = shingle_sets(texts(batch), width)
        for s, sign in zip(found, signatures(found)):
            if len(s) and sign not in met:
                met.add(sign)
                signs.append(sign)
                sets.append(s)
        if sets:
            yield signs, sets


def _by_bucket(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows ``(bucket, bytes…)``: entries are shuffled as blocks, by the top bits of their keys."""
    bucket = (spread(keys.astype(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sorted_columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        yield int(b), *(c[lo:hi].tobytes() for c in sorted_columns)


def _joined(values, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


# ---------------------------------------------------------------- frequent elements

class Ranks:
    """How frequent elements are, in steps of four times: nested filters, most elements are in none."""

    def __init__(self, levels: list[np.ndarray]):
        self.filters = [BitFilter(v, min(max((16 * len(v)).bit_length(), 13), FILTER_BITS)) for v in levels]

    def of(self, values: np.ndarray) -> np.ndarray:
        rank, at = np.zeros(len(values), np.int8), np.arange(len(values))
        for own in self.filters:
            at = at[own.has(values[at])]
            rank[at] += 1
        return rank


def element_ranks(docs: DataFrame, buckets: int, width: int) -> Ranks:
    """Ranks that put the elements many sets hold last in the order of elements.

    Counts cover all sets, by 32 bits of the element.  The filters take the most frequent million
    at most; what they leave out, or admit wrongly, changes the order for all sets alike and
    costs time only.
    """
    def emit(batches):
        for _, sets in _distinct_sets(batches, width):
            short = np.concatenate(sets).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*_by_bucket(short, buckets, short)), (pa.int32(), pa.binary()))], ["bucket", "data"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        values, n = np.unique(_joined(rows["data"], "<u4"), return_counts=True)
        values, n = values[n >= FREQUENT], n[n >= FREQUENT]
        level = np.floor(np.log2(n)).astype(int)
        out = [(int(l), int((level == l).sum()), values[level == l].tobytes()) for l in np.unique(level)]
        return pd.DataFrame(out, columns=["level", "n", "data"])

    counted = docs.select("text").mapInArrow(emit, "bucket int, data binary").groupBy("bucket").applyInPandas(count, "level int, n long, data binary")
    counted = save(counted, "frequent")
    left, least = MOST_FREQUENT, None
    for level, n in sorted(((r.level, r.n) for r in counted.groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = level
    rows = counted.where(F.col("level") >= least).select("level", "data").collect() if least is not None else []
    steps = range(least, max(r.level for r in rows) + 1, 2) if rows else ()
    return Ranks([_joined([bytes(r.data) for r in rows if r.level >= step], "<u4") for step in steps])


# ---------------------------------------------------------------- lists and candidates

def _light_keys(s: np.ndarray, light: int, percent: int) -> Iterator[np.ndarray]:
    n = len(s)
    for b in _partners(n, percent):
        if b > light:
            continue
        low, high = min(n, b), max(n, b)
        share = required(low, high, percent)
        if share > low:
            continue
        chosen = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), share)), np.int64).reshape(-1, share)
        mixed = spread(s + np.uint64(0x51ED27))[chosen].sum(axis=1, dtype=np.uint64)
        yield low, spread(mixed ^ np.uint64(low * 64 + high + 1))


def _entries(signs, sets, ranks: Ranks, light: int, percent: int):
    """Keys, sets, sizes, kinds (0: heavy, else the smaller size of a light class) and places in the common order."""
    keys, own, sizes, kinds, places = [], [], [], [], []

    def add(k, sign, n, kind):
        keys.append(k)
        own.append(np.full(len(k), sign, np.int64))
        sizes.append(np.full(len(k), n, np.int32))
        kinds.append(np.full(len(k), kind, np.uint8))
        places.append(np.zeros(len(k), np.int32) if kind else np.arange(len(k), dtype=np.int32))

    rank = ranks.of(np.concatenate(sets).astype(np.uint32))
    at = 0
    for sign, s in zip(signs, sets):
        n, own_rank = len(s), rank[at:at + len(s)]
        at += n
        if n <= light:
            for low, k in _light_keys(s, light, percent):
                add(k, sign, n, low)
        if 100 * n >= percent * (light + 1):
            first = np.argsort(own_rank, kind="stable")[:prefix(n, percent)]
            add(s[first], sign, n, 0)
    if not keys:
        return None
    return tuple(np.concatenate(x) for x in (keys, own, sizes, kinds, places))


GROUP_SCHEMA = "gid long, sign long, size int, centre long, centre_size int, linked boolean"


def _with_partner(sizes: np.ndarray, places: np.ndarray, lists: np.ndarray, percent: int) -> np.ndarray:
    """Members of heavy lists that may have a partner there whose first common element is the list's.

    Sizes must fit, and what both sets hold from the list's element on must be enough.  In a list of more than
    ``NEIGHBOURS + 1`` members only sizes count.  Linked sets stay together in the list of their first common element.
    """
    order = np.lexsort((sizes, lists))
    sizes, places, lists = sizes[order].astype(np.int64), places[order], lists[order]
    stays, long = np.zeros(len(sizes), bool), np.bincount(lists)[lists] > NEIGHBOURS + 1 if len(lists) else np.zeros(0, bool)
    for d in range(1, min(NEIGHBOURS, len(sizes) - 1) + 1):
        a, b = sizes[:-d], sizes[d:]  # a list's sizes ascend
        fits = (lists[:-d] == lists[d:]) & (100 * a >= percent * b)
        enough = (100 + percent) * np.minimum(a - places[:-d], b - places[d:]) >= percent * (a + b)
        fits &= enough | long[d:]
        stays[:-d] |= fits
        stays[d:] |= fits
    out = np.zeros(len(sizes), bool)
    out[order] = stays
    return out


def _lists(rows: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """The lists of one bucket that hold two sets or more that may be linked; lists of the same sets once."""
    keys, signs = _joined(rows["keys"], "<u8"), _joined(rows["signs"], "<i8")
    sizes, kinds, places = _joined(rows["sizes"], "<i4"), _joined(rows["kinds"], "u1"), _joined(rows["places"], "<i4")
    # most elements are in one set only
    order = np.lexsort((kinds, keys))
    k, i = keys[order], kinds[order]
    same = (k[1:] == k[:-1]) & (i[1:] == i[:-1])
    met = order[np.append(same, False) | np.append(False, same)] if len(k) else order
    keys, signs, sizes, kinds, places = (x[met] for x in (keys, signs, sizes, kinds, places))
    # a set that several tasks have met is in its lists several times
    order = np.lexsort((signs, kinds, keys))
    keys, signs, sizes, kinds, places = (x[order] for x in (keys, signs, sizes, kinds, places))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])
    once = new.copy()
    once[1:] |= signs[1:] != signs[:-1]
    number, heavy = np.cumsum(new), once & (kinds == 0)
    once[heavy] = _with_partner(sizes[heavy], places[heavy], number[heavy], percent)
    keys, signs, sizes, kinds = (x[once] for x in (keys, signs, sizes, kinds))
    rank = spread(signs.view(np.uint64))
    # members of the smaller size come first in a light list, so that its centre is one of them
    late = (kinds > 0) & (sizes != kinds)
    order = np.lexsort((rank, late, kinds, keys))
    keys, signs, sizes, kinds, rank = keys[order], signs[order], sizes[order], kinds[order], rank[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return pd.DataFrame(columns=["gid", "sign", "size", "centre", "centre_size", "linked"])
    counts = np.diff(np.append(starts, len(keys)))
    gid = spread(np.add.reduceat(rank, starts) + kinds[starts].astype(np.uint64))
    useful = (counts > 1) & ((kinds[starts] == 0) | (sizes[starts] == kinds[starts]))
    once = np.zeros(len(starts), bool)
    once[np.unique(gid, return_index=True)[1]] = True
    # lists of equal sets and kind have equal numbers, so either all or none of them are useful
    run = np.repeat(np.arange(len(starts)), counts)
    keep = (useful & once)[run]
    at = starts[run][keep]
    return pd.DataFrame({
        "gid": gid[run][keep].view(np.int64), "sign": signs[keep], "size": sizes[keep],
        "centre": signs[at], "centre_size": sizes[at], "linked": kinds[keep] > 0,
    })


def _met(docs: DataFrame, ranks: Ranks, light: int, buckets: int, width: int, percent: int) -> DataFrame:
    """Rows ``GROUP_SCHEMA``: every list with its members, each list of equal members once."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def emit(batches):
        for signs, sets in _distinct_sets(batches, width):
            made = _entries(signs, sets, shared.value, light, percent)
            if made:
                kinds = (pa.int32(), *[pa.binary()] * 5)
                rows = zip(*_by_bucket(made[0], buckets, *made))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["bucket", "keys", "signs", "sizes", "kinds", "places"])

    def lists(rows: pd.DataFrame) -> pd.DataFrame:
        return _lists(rows, percent)

    entries = docs.select("text").mapInArrow(emit, "bucket int, keys binary, signs binary, sizes binary, kinds binary, places binary")
    return entries.groupBy("bucket").applyInPandas(lists, GROUP_SCHEMA).dropDuplicates(["gid", "sign"])


# ---------------------------------------------------------------- verification

def _filter_of(wanted: DataFrame) -> BitFilter:
    """A filter of the numbers in ``sign``, of a written table; its blocks are filled and merged by the executors."""
    size = min(max((10 * wanted.count()).bit_length(), 16), FILTER_BITS)

    def fill(parts):
        bits = np.zeros(1 << (size - 3), np.uint8)
        for part in parts:
            bits |= BitFilter(part["sign"].to_numpy().view(np.uint64), size).bits
        yield pd.DataFrame([(k, b.tobytes()) for k, b in enumerate(np.split(bits, BLOCKS)) if b.any()], columns=["block", "data"])

    def merge(rows):
        bits = np.bitwise_or.reduce([np.frombuffer(data, np.uint8) for data in rows["data"]])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [bits.tobytes()]})

    filled = wanted.select("sign").coalesce(BLOCKS).mapInPandas(fill, "block int, data binary")
    chosen = BitFilter(np.zeros(0, np.uint64), size)
    for r in filled.groupBy("block").applyInPandas(merge, "block int, data binary").collect():
        np.split(chosen.bits, BLOCKS)[r.block][:] = np.frombuffer(bytes(r.data), np.uint8)
    return chosen


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``sign, data``: the elements of the wanted sets, read again from the texts.

    A filter of fixed size keeps most others out before the exact join.
    """
    chosen = _filter_of(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def read(batches):
        for signs, sets in _distinct_sets(batches, width):
            take = np.flatnonzero(shared.value.has(np.array(signs, np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([signs[i] for i in take], pa.int64()), pa.array([sets[i].tobytes() for i in take], pa.binary())], ["sign", "data"])

    found = docs.select("text").mapInArrow(read, "sign long, data binary")
    return found.join(wanted, "sign", "left_semi").dropDuplicates(["sign"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets are similar enough.  ``pairs`` is a written table; only sets it names are moved.

    Both joins shuffle both sides where these are large, so hot sets split.
    """
    def check(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    def named(side: str) -> DataFrame:
        return sets.select(F.col("sign").alias(side), F.col("data").alias(f"of_{side}")).join(pairs.select(side), side, "left_semi")

    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``gid, sign, size, component`` of the lists that hold sets of different groups."""
    placed = lists.join(groups, F.col("sign") == F.col("node"), "left").select(
        "gid", "sign", "size", F.coalesce("component", "sign").alias("component"))
    placed = save(placed, "placed")
    mixed = placed.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gid")
    return save(placed.join(mixed, "gid", "left_semi"), "open")


def _by_centre(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member with the set of its list that meets the most others, if in another group."""
    sizes = save(lists.groupBy("gid").agg(F.count(F.lit(1)).alias("n")), "met")
    weight = save(lists.join(sizes, "gid").groupBy("sign").agg(F.sum("n").alias("weight")), "weights")
    weighed = lists.join(weight, "sign")
    best = weighed.groupBy("gid").agg(F.max(F.struct("weight", F.xxhash64("sign").alias("h"), "sign", "size", "component")).alias("c"))
    best = save(best.select("gid", F.col("c.sign").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.component").alias("centre_group")), "centres")
    near = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    return _pairs(lists.join(best, "gid").where((F.col("component") != F.col("centre_group")) & near), "centre", "sign")


def _sketches(sets: DataFrame) -> DataFrame:
    """``sign, sketch``: how often, odd or even, the elements of a set fall in each of ``SKETCH_BITS`` places."""
    def sketch(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                place = (spread(np.frombuffer(data, "<u8") ^ np.uint64(0x5BD1E995)) % np.uint64(SKETCH_BITS)).astype(np.int64)
                out.append(np.packbits(np.bincount(place, minlength=SKETCH_BITS) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["sign", "sketch"])

    return sets.select("sign", "data").mapInArrow(sketch, "sign long, sketch binary")


def possible_pairs(
    sizes: np.ndarray, components: np.ndarray, sketches: np.ndarray, sides: np.ndarray, percent: int, forest: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that may be similar: of different groups and fitting sizes, and not too far apart.

    With ``forest`` only as many as it takes to join what may belong together: fewer than there are groups.

    Each element that only one of two sets holds changes at most one place, so sketches that differ in ``d`` places
    belong to sets with an intersection of ``(a + b - d) / 2`` at most.  ``sides`` tells the two
    halves of a tile apart: only pairs over both are made if there are two.
    """
    words, components = sketches.view(np.uint64), components.copy()
    found_a, found_b = [], []
    two = len(np.unique(sides)) > 1
    for i in range(len(sizes) - 1):
        other = slice(i + 1, None)
        a, b = sizes[i], sizes[other]
        fits = (components[other] != components[i]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if two:
            fits &= sides[other] != sides[i]
        at = np.flatnonzero(fits) + i + 1
        if len(at):
            apart = np.bitwise_count(words[at] ^ words[i]).sum(axis=1, dtype=np.int64)
            total = sizes[at] + a
            at = at[(100 + percent) * (total - apart) >= 2 * percent * total]
            if forest and len(at):
                joined, first = np.unique(components[at], return_index=True)
                components[np.isin(components, joined)] = components[i]
                at = at[first]
            found_a.append(np.full(len(at), i))
            found_b.append(at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _possible(lists: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``a, b``: pairs of sets of an open list that sketches do not rule out, or a forest of them.

    A list is dealt into chunks, and each two chunks meet in a tile: neither a list nor its pairs are in one
    task, and only possible pairs leave it.
    """
    chunks = save(lists.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks")), "chunks")
    own = F.pmod(F.xxhash64("sign", F.lit(5)), F.col("chunks")).cast("int")
    member = lists.join(chunks, "gid").join(sketches, "sign").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tiles = member.select("gid", "sign", "size", "component", "sketch", "own", other)
    tiles = tiles.withColumn("tile", F.xxhash64("gid", F.least("own", "other"), F.greatest("own", "other")))
    buckets = max(64, chunks.agg(F.coalesce(F.sum(F.col("chunks").cast("long") * F.col("chunks")), F.lit(0))).first()[0] // 200)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "sign"], kind="stable")
        tile, sign, size, component, side = (rows[c].to_numpy() for c in ("tile", "sign", "size", "component", "own"))
        size, sketch = size.astype(np.int64), np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        counts = np.diff(np.append(starts, len(tile)))
        # most tiles hold one pair
        i = starts[counts == 2]
        low, high = np.minimum(size[i], size[i + 1]), np.maximum(size[i], size[i + 1])
        i = i[(component[i] != component[i + 1]) & (100 * low >= percent * high)]
        apart = np.bitwise_count(sketch[i].view(np.uint64) ^ sketch[i + 1].view(np.uint64)).sum(axis=1, dtype=np.int64)
        i = i[(100 + percent) * (size[i] + size[i + 1] - apart) >= 2 * percent * (size[i] + size[i + 1])]
        found = [(i, i + 1)]
        for lo, n in zip(starts[counts > 2], counts[counts > 2]):
            own = slice(lo, lo + n)
            a, b = possible_pairs(size[own], component[own], sketch[own], side[own], percent, forest)
            found.append((a + lo, b + lo))
        a, b = (sign[np.concatenate(x)] for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    dealt = tiles.withColumn("bucket", F.pmod(F.col("tile"), F.lit(buckets)).cast("int"))
    return dealt.select("bucket", "tile", "sign", "size", "component", "own", "sketch").groupBy("bucket").applyInPandas(run, "a long, b long")


def similar_groups(docs: DataFrame, ids: str = "doc_id", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``ids``, ``text``).

    Two sets link when ``100 * intersection >= percent * union``; a component is named by its
    smallest id.  Rows without words or text link with nothing, rows without an id too; equal
    rows are in one component.  A row alone is its own component.
    """
    classed = _classed(docs, ids, width, percent)
    least = save(classed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return classed.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _classed(docs: DataFrame, ids: str, width: int, percent: int) -> DataFrame:
    """``doc_id, digest, n_shingles, component`` of every row: its text's md5, and a name for the component of its set.

    ``component`` is NULL without an id or a set.
    """
    docs = docs.select(F.col(ids).cast("long").alias("doc_id"), "text")

    def sizes(batches):
        for batch in slices(batches, most=AT_ONCE):
            sets = shingle_sets(texts(batch), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures(sets), pa.int64())],
                ["doc_id", "digest", "n_shingles", "sign"])

    with_digest = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = save(with_digest.mapInArrow(sizes, "doc_id long, digest string, n_shingles long, sign long"), "sets")
    used = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    small = used.where(F.col("n_shingles") <= 2 * LARGEST_LIGHT).groupBy("n_shingles").agg(F.countDistinct("sign").alias("n"))
    light = boundary({r.n_shingles: r.n for r in small.collect()}, percent)
    buckets = max(64, rows.count() // 1000)

    named = docs.where(F.col("doc_id").isNotNull())
    met = save(_met(named, element_ranks(named, buckets, width), light, buckets, width, percent), "lists")
    near = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    linked = met.where(F.col("linked") & (F.col("sign") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("sign").alias("b"))
    lists = met.where(~F.col("linked"))
    pairs = save(_pairs(lists.where((F.col("sign") != F.col("centre")) & near), "centre", "sign"), "pairs")
    sets = _whole_sets(named, save(pairs.select(F.explode(F.array("a", "b")).alias("sign")).distinct(), "wanted"), width)
    links = save(linked.union(_verified(pairs, save(sets, "whole"), percent)), "links")
    groups = save(components(links), "groups")

    # lists whose sets are in different groups: once more with the set that most others meet
    still = _open(lists.select("gid", "sign", "size"), groups)
    central = save(_by_centre(still, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    sets = save(_whole_sets(named, save(still.select("sign").distinct(), "wanted"), width), "whole")
    links = save(links.union(_verified(central, sets, percent)), "links")
    groups = save(components(links), "groups")

    # what still meets in a list from different groups, as far as sketches leave a pair possible: first so many
    # pairs as could join all that may belong together, then every pair of what is in different groups even so
    sketches, tried = save(_sketches(sets), "sketches"), pairs.union(central)
    still = _open(still.select("gid", "sign", "size"), groups)
    joining = save(_pairs(_possible(still, sketches, percent, True), "a", "b").join(tried, ["a", "b"], "left_anti"), "joining")
    links = save(links.union(_verified(joining, sets, percent)), "links")
    groups = save(components(links), "groups")
    still = _open(still.select("gid", "sign", "size"), groups)
    rest = _pairs(save(_possible(still, sketches, percent, False), "possible"), "a", "b").join(tried.union(joining), ["a", "b"], "left_anti")
    more = _verified(save(rest, "rest"), sets, percent)
    groups = save(components(save(links.union(more), "links")), "groups")

    of_sign = save(groups.select(F.col("node").alias("sign"), "component"), "classes")
    signed = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("sign"))
    return rows.withColumn("sign", signed).join(of_sign, "sign", "left").select(
        "doc_id", "digest", "n_shingles", F.coalesce("component", "sign").alias("component"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, and then md5 of the text.

    Decisions are by id and text, so a row is never dropped for another row of its id.  Of rows equal in both,
    the first by a hash of all columns stays.  Rows without an id, and rows without words, stay all of them: they link with nothing.
    Only rows that a filter of fixed size takes for ones that go, or are repeated, are shuffled with their texts.
    """
    digest, name, of_name, number, decided = free_names(docs.columns, "_digest", "_id", "_text", "_number", "_decided")
    classed = save(_classed(docs, "doc_id", width, percent).where("component is not null"), "classed")
    rows = classed.groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = save(rows, "distinct")
    first = save(rows.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("f")), "first")
    # both tables are small beside the texts: what goes, and what is repeated
    judged = rows.join(first, "component").withColumn("stays", F.struct("doc_id", "digest") == F.col("f"))
    names = [F.col("doc_id").alias(name), F.col("digest").alias(of_name)]
    gone = save(judged.where("not stays").select(*names), "gone")
    repeated = save(judged.where("stays and n > 1").select(*names), "repeated")
    signs = gone.union(repeated).select(F.xxhash64(name, of_name).alias("sign"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(signs))

    @F.pandas_udf("boolean")
    def may_be_decided(sign: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(sign.to_numpy().view(np.uint64)))

    told = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    told = told.withColumn(decided, may_be_decided(F.xxhash64(F.col("doc_id").cast("long"), F.col(digest))))
    columns = quoted(docs.columns)
    others = told.where(~F.col(decided)).select(*columns)
    same = (F.col("doc_id").cast("long") == F.col(name)) & (F.col(digest) == F.col(of_name))
    kept = told.where(F.col(decided)).join(gone, same, "left_anti")
    again = kept.join(repeated, same, "left_semi").groupBy("doc_id", digest).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(number))
    once = kept.join(repeated, same, "left_anti").select(*columns)
    return others.union(once).union(again.select(*[F.col(number).getField(c).alias(c) for c in docs.columns]))
