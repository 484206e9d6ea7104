"""Ranked lexical search over norm buckets: impact vectors longest first, pruned before they are scored.

A document is the vector of its terms' impacts, an item the vector of its terms' weights, and a score their
product.  Per task, documents stand in buckets by length.  A bucket is passed over when the product of lengths
(Cauchy-Schwarz) stays below the least score an item still needs; inside, the item's few heaviest
coordinates are added up and the rest bounded; only documents that pass are scored, in integers.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lendlane.llm.heaps import Heaps
from lendlane.llm.shared import save, shared_folder, slices, texts

# A-Z in lower case; what is no letter, digit or byte of a longer character separates terms
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``block_bytes`` and ``block_items`` bound the items of one pass, ``entries`` the vectors held at once."""

    most: int = 10
    block_bytes: int = 1 << 20
    block_items: int = 2000
    entries: int = 4_000_000
    bucket: int = 2048
    ratio: float = 0.8
    focus: int = 6


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TERMS).split()


@dataclass(frozen=True)
class _Queries:
    """Items as vectors over their own terms, numbered; the heaviest terms of an item first."""

    vocabulary: dict[bytes, int]
    term: np.ndarray
    weight: np.ndarray
    begins: np.ndarray
    documents: int
    words: int

    def __len__(self) -> int:
        return len(self.begins) - 1


class _Bucket:
    """Documents of similar length, their entries by term."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, norm: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.norm, self.row, self.term, self.impact = ids, norm, row[order], term[order], impact[order]
        first = np.flatnonzero(np.diff(self.term, prepend=-1))
        self.known, self.first = self.term[first], np.append(first, len(term))
        self.highest = np.maximum.reduceat(self.impact, first) if len(first) else self.impact

    def postings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each term's entries and its highest impact; 0, 0 and 0 for an absent one."""
        if not len(self.known):
            return (np.zeros(len(wanted), np.int64),) * 3
        at = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        there = self.known[at] == wanted
        return tuple(np.where(there, x, 0) for x in (self.first[at], self.first[at + 1], self.highest[at]))

    def search(self, queries: _Queries, needed: np.ndarray, focus: int):
        """Per item the rows whose score may reach what is needed, and their exact scores."""
        slack, longest = 1 + 1e-9, self.norm.max(initial=0.0)
        lengths = np.sqrt(np.add.reduceat(np.append(queries.weight.astype(float) ** 2, 0.0), queries.begins[:-1])) if len(queries) else np.zeros(0)
        lengths[np.diff(queries.begins) == 0] = 0
        low, high, top = self.postings(queries.term)
        for item in np.flatnonzero((lengths * longest * slack >= needed) & (lengths > 0)):
            own = slice(queries.begins[item], queries.begins[item + 1])
            weight, lo, hi = queries.weight[own], low[own], high[own]
            part, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))
            for w, a, b in zip(weight[:focus], lo, hi):
                row, impact = self.row[a:b], self.impact[a:b].astype(float)
                part[row] += w * impact
                squares[row] += impact * impact
            rest = weight[focus:].astype(float)
            by_length = math.sqrt(rest @ rest) * np.sqrt(np.maximum(self.norm ** 2 * slack - squares, 0))
            by_coordinate = rest @ top[own][focus:].astype(float)
            rows = np.flatnonzero((part + np.minimum(by_length, by_coordinate)) * slack >= needed[item])
            if len(rows):
                yield item, rows, self._scores(rows, weight, lo, hi)

    def _scores(self, rows: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        total = np.zeros(len(rows), np.int64)
        for w, a, b in zip(weight, low, high):
            at = place[self.row[a:b]]
            hit = at >= 0
            total[at[hit]] += w * self.impact[a:b][hit]  # a document has a term once
        return total


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n`` and the counts of the terms of the vocabulary, of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, term, count, ends = [], [], [], [0]
            for text in texts(batch):
                words = terms(text)
                held = Counter(map(vocabulary.get, words))
                held.pop(None, None)
                sizes.append(len(words))
                term.extend(held.keys())
                count.extend(held.values())
                ends.append(len(term))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (term, count))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "term", "count"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, term array<int>, count array<int>")


def _held(batches: Iterator[pa.RecordBatch], queries: _Queries, settings: Settings):
    """The documents of a task as lists of buckets, as many entries at a time as the settings allow."""
    parts, size = [], 0
    for batch in batches:
        parts.append(batch)
        size += len(batch.column(2).flatten()) + batch.num_rows
        if size >= settings.entries:
            yield list(_buckets(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], queries, settings))
            parts, size = [], 0
    parts = [p for p in parts if p.num_rows]
    if parts:
        yield list(_buckets(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], queries, settings))


NO_ID = np.iinfo(np.int64).max


def _buckets(batch: pa.RecordBatch, queries: _Queries, settings: Settings) -> Iterator[_Bucket]:
    """Longest first; a bucket ends when it is full or its vectors get much shorter than its first."""
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    n = batch.column(1).to_numpy(zero_copy_only=False)
    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    term = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    count = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), lengths)
    measure = np.array([100 - 75 + 75 * x * queries.documents // queries.words for x in n.tolist()], np.int64)
    impact = 1_000_000_000 * count // (1000 * count + 8 * measure[owner])
    norm = np.sqrt(np.bincount(owner, impact.astype(float) ** 2, len(ids)))
    order = np.argsort(-norm, kind="stable")
    order = order[norm[order] > 0]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    start = 0
    while start < len(order):
        least = settings.ratio * norm[order[start]]
        end = start + int(np.searchsorted(-norm[order[start:start + settings.bucket]], -least, side="right"))
        rows = order[start:end]
        entries = np.repeat(begins[rows] - np.concatenate([[0], np.cumsum(lengths[rows])])[:-1], lengths[rows]) + np.arange(lengths[rows].sum())
        yield _Bucket(ids[rows], np.repeat(np.arange(len(rows)), lengths[rows]), term[entries], impact[entries], norm[rows])
        start = end


def _ranked(vectors: DataFrame, queries: _Queries, needed: np.ndarray, longest_only: bool, settings: Settings) -> DataFrame:
    """``item, doc_id, score, rank``: the best documents per item among those that reach ``needed``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(queries), settings.most)
        heaps.floor = needed.copy()
        for buckets in _held(batches, queries, settings):
            for bucket in buckets[:1] if longest_only else buckets:
                hits = []
                for item, rows, scores in bucket.search(queries, heaps.floor, settings.focus):
                    fits = scores >= heaps.floor[item]
                    hits.append((np.full(fits.sum(), item), scores[fits], bucket.ids[rows[fits]]))
                if hits:
                    heaps.add(*(np.concatenate(x) for x in zip(*hits)))
        columns = [pa.array(heaps.group), pa.array(heaps.id, mask=heaps.id == NO_ID), pa.array(heaps.score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    found = vectors.mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.most)


def _weighted(parts: list[str], vectors: DataFrame, vocabulary: dict[bytes, int], documents: int, words: int) -> _Queries:
    held = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df]
    term, weight, begins = [], [], [0]
    for text in parts:
        own = Counter(vocabulary[t] for t in terms(text))
        entries = sorted(((weights[t] * n, t) for t, n in own.items() if df[t]), reverse=True)
        term += [t for _, t in entries]
        weight += [w for w, _ in entries]
        begins.append(len(term))
    return _Queries(vocabulary, np.array(term, np.int64), np.array(weight, np.int64), np.array(begins), documents, words)


def search(items: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: per item the ``most`` best documents with a score above 0.

    ``items`` has ``item_id, text``, ``docs`` has ``doc_id, text``; further columns do no harm.  A NULL text has no
    terms.  Equal scores go by ``doc_id``; a NULL id comes last, and counts as 2^63-1.  Repeated rows are documents
    of their own.  A repeated item comes as often, each with ranks from 1.  Items without terms or without a document give no
    row, and so does an empty table.

    Items are dealt into blocks of bounded size; a block, its terms and their counts pass the driver, documents do not.
    The longest vectors of each task are searched first: the scores they reach are what all others must reach.
    """
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = save(items.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // settings.block_items), -(-size // settings.block_bytes))
    folder = f"{shared_folder(spark)}/llm-search-{uuid.uuid4().hex}"
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("row").select("row", "text").collect()
        parts = [r.text for r in own]
        vocabulary = {t: k for k, t in enumerate(sorted({t for text in parts for t in terms(text)}))}
        vectors = save(_vectors(docs, vocabulary), "impacts")
        documents, words = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        queries = _weighted(parts, vectors, vocabulary, documents, max(words, 1))
        needed = np.ones(len(own), np.int64)
        for r in _ranked(vectors, queries, needed, True, settings).where(F.col("rank") == settings.most).select("item", "score").collect():
            needed[r["item"]] = r.score
        best = _ranked(vectors, queries, needed, False, settings)
        numbers = spark.createDataFrame([(k, r.row) for k, r in enumerate(own)], "item long, row long")
        found = best.join(F.broadcast(numbers), "item").join(F.broadcast(asked.select("item_id", "row").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number)), "row")
        found.select("item_id", "rank", "doc_id", "score").write.mode("overwrite").parquet(f"{folder}/block={number}")
    return spark.read.schema(f"item_id {kind}, rank int, doc_id long, score long").parquet(*[f"{folder}/block={n}" for n in range(blocks)])


ORACLE = r"""
with pieces as (
 select 'd' as kind, doc_id as id, row_number() over () as r, text from documents
 union all select 'i', item_id, row_number() over (), text from benchmark),
words as (
 select kind, id, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from pieces),
counted as (select kind, id, r, term, count(*) as tf from words group by all),
sized as (select r, sum(tf)::bigint as n from counted where kind = 'd' group by r),
whole as (select count(*) as docs, sum(n)::bigint as words from sized),
known as (
 select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w
 from (select term, count(*) as df from counted where kind = 'd' group by term), whole),
impacts as (
 select c.id as doc_id, c.r, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))) as gain
 from counted c join sized on sized.r = c.r join known on known.term = c.term, whole where c.kind = 'd'),
scored as (
 select i.id as item_id, i.r, doc_id, impacts.r as doc_row, sum(tf * gain)::bigint as score
 from counted i join impacts on impacts.term = i.term where i.kind = 'i' group by all)
select item_id, (row_number() over (partition by item_id, r order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10"""
