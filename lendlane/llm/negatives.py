"""Hard negatives for anchors: exact integer scores by Strassen's recursion, then mergeable heaps.

Vectors are rounded down to integers.  A block of anchors, of bounded size, meets all rows tile by tile;
a tile of scores is a product of two 64-bit matrices, split into quarters padded with zeros until a leaf is
small.  Heaps of fixed length keep the best positives, and in a second pass the best negatives of each
positive's window; heaps of all tasks are merged by a ranking of their few rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lendlane.llm.heaps import Heaps
from lendlane.llm.shared import save, shared_folder


@dataclass(frozen=True)
class Settings:
    """``block_bytes`` and ``block_rows`` bound the anchors of one pass, ``tile`` the scores in memory."""

    positives: int = 5
    negatives: int = 5
    lowest: int = 80
    highest: int = 100
    scale: int = 256
    tile: int = 512
    leaf: int = 16
    block_rows: int = 4096
    block_bytes: int = 1 << 25


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """``a @ b`` of 64-bit integers by seven products of halves; exact modulo 2^64."""
    rows, inner, columns = *a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    r, i, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    (nw, ne), (sw, se) = (a[:r, :i], a[:r, i:]), (a[r:, :i], a[r:, i:])
    (top, right), (left, low) = (b[:i, :c], b[:i, c:]), (b[i:, :c], b[i:, c:])
    both = strassen(nw + se, top + low, leaf)
    lower = strassen(sw + se, top, leaf)
    across = strassen(nw, right - low, leaf)
    down = strassen(se, left - top, leaf)
    upper = strassen(nw + ne, low, leaf)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = both + down - upper + strassen(ne - se, left + low, leaf)
    out[:r, c:] = across + upper
    out[r:, :c] = lower + down
    out[r:, c:] = both - lower + across + strassen(sw - nw, top + right, leaf)
    return out[:rows, :columns]


def integer_rows(rows: DataFrame, label: str, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, ``v`` being ``floor(scale * x)`` per component.

    Rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part.
    Products beyond 64 bits are cut to them.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(settings.scale) * x.cast("double")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    ).select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of integers as rows of a matrix, short ones padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _as_wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


@dataclass(frozen=True)
class _Block:
    """Anchors of one pass; ``ids`` may repeat, their place in the block tells them apart."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def tiles(self, batches: Iterator[pa.RecordBatch], settings: Settings):
        """Per tile: the slice of anchors, ids and labels of the candidates, and the scores."""
        for batch in batches:
            for start in range(0, batch.num_rows, settings.tile):
                part = batch.slice(start, settings.tile)
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                vectors = _matrix(part.column(2))
                width = max(vectors.shape[1], self.vectors.shape[1])
                candidates = np.ascontiguousarray(_as_wide(vectors, width).T)
                for low in range(0, len(self.ids), settings.tile):
                    own = slice(low, min(low + settings.tile, len(self.ids)))
                    yield own, ids, labels, strassen(_as_wide(self.vectors[own], width), candidates, settings.leaf)


def _best(rows: DataFrame, group: list[str], score: str, ids: str, most: int, rank: str) -> DataFrame:
    """Merge the heaps of all tasks; only their rows are shuffled."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(ids))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def _positives(rows: DataFrame, block: _Block, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(block.ids), settings.positives)
        for own, ids, labels, scores in block.tiles(batches, settings):
            fits = (block.labels[own, None] == labels) & (block.ids[own, None] != ids) & (scores >= heaps.floor[own, None])
            anchor, candidate = np.nonzero(fits)
            heaps.add(anchor + own.start, scores[anchor, candidate], ids[candidate])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (heaps.group, heaps.id, heaps.score)], ["anchor", "positive_id", "positive_score"])

    found = rows.mapInArrow(run, "anchor long, positive_id long, positive_score long")
    return _best(found, ["anchor"], "positive_score", "positive_id", settings.positives, "place")


def _negatives(rows: DataFrame, block: _Block, places: np.ndarray, positive: np.ndarray, positive_score: np.ndarray, settings: Settings) -> DataFrame:
    """The best negatives in the window of each positive; ``places`` numbers the positives' anchors."""
    common = gcd(settings.lowest, gcd(100, settings.highest))
    low, whole, high = settings.lowest // common, 100 // common, settings.highest // common
    number = np.arange(len(places))
    rank = number - np.searchsorted(places, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(places), settings.negatives)
        for own, ids, labels, scores in block.tiles(batches, settings):
            other = block.labels[own, None] != labels
            for r in range(settings.positives):  # the positives of one rank, an anchor each
                mine = number[(rank == r) & (places >= own.start) & (places < own.stop)]
                at, least = places[mine] - own.start, positive_score[mine, None]
                here = scores[at]
                fits = other[at] & (low * least <= whole * here) & (whole * here <= high * least) & (here >= heaps.floor[mine, None])
                which, candidate = np.nonzero(fits)
                heaps.add(mine[which], here[which, candidate], ids[candidate])
        found = heaps.group
        columns = [found, block.ids[places[found]], positive[found], heaps.id, positive_score[found], heaps.score]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["pair", *NAMES])

    found = rows.mapInArrow(run, "pair long, " + ", ".join(f"{n} long" for n in NAMES))
    return _best(found, ["pair"], "negative_score", "negative_id", settings.negatives, "rank")


NAMES = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, anchors: str, label: str, settings: Settings = Settings()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, all long but the int ``rank``.

    ``rows`` has ``vec_id, label, embedding``; further columns do no harm.  ``anchors`` and ``label`` are SQL: which rows
    are anchors, and what a row's label is.  An anchor's positives are its best other rows of the same
    label, its negatives per positive the best rows of another label with
    ``lowest`` to ``highest`` per cent of the positive's score.  Rows of one id are not "other rows" of each other.
    A repeated row counts each time: as a candidate, and as an anchor, whose result then comes as often.
    Vectors of different lengths are compared as if padded with zeros.  Anchors without a positive,
    and positives without a negative, give no row; an empty table gives none.

    Anchors are dealt into blocks of bounded size; each block passes over all rows twice, and only it
    and its positives reach the driver.
    """
    spark = rows.sparkSession
    whole = integer_rows(rows, label, settings)
    chosen = save(whole.where(F.expr(anchors)).withColumn("row", F.monotonically_increasing_id()), "anchors")
    n, width = chosen.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(1, min(settings.block_rows, settings.block_bytes // (8 * max(width or 1, 1))))
    blocks = max(1, -(-n // most))
    folder = f"{shared_folder(spark)}/llm-negatives-{uuid.uuid4().hex}"
    for number in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("vec_id", "row").toArrow()
        ids, labels = (own.column(k).to_numpy().astype(np.int64) for k in ("vec_id", "label"))
        lists = own.column("v").combine_chunks()
        block = _Block(ids, labels, _matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists))
        best = _positives(whole, block, settings).orderBy("anchor", "place").toArrow()
        places, positive, score = (best.column(k).to_numpy().astype(np.int64) for k in ("anchor", "positive_id", "positive_score"))
        found = _negatives(whole, block, places, positive, score, settings)
        found.select(*COLUMNS).write.mode("overwrite").parquet(f"{folder}/block={number}")
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") \
        .parquet(*[f"{folder}/block={number}" for number in range(blocks)])


# Every 100th id is an anchor, every 7th row gets the next of ten labels.
ANCHORS = "vec_id % 100 = 0"
SHIFTED = "case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end"

ORACLE = """
with r as (
 select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as v
 from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
 select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
 from r a join r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (
 select anchor_id, other_id as positive_id, score as positive_score from s where same
 qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
 select p.*, s.other_id as negative_id, s.score as negative_score,
  row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id) as rank
 from p join s on s.anchor_id = p.anchor_id and not s.same and s.score between 0.8 * positive_score and positive_score
  and 80 * positive_score <= 100 * s.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
