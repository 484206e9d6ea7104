"""Quality by a logistic regression over hashed word n-grams, learned with follow-the-regularised-leader updates.

A text is cut into words and runs of one sign; its n-grams are hashed into a fixed number of
places.  Learning goes on shard by shard in parallel: each shard follows the leader row by row from the
common state, then the states are averaged, place by place, over the shards that touched it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import SPACES, PrefixHash, fold, save, slices, spread, texts

LIMIT = 0.3
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Places whose state is averaged in one group, and the columns of a state.
BLOCK = 1 << 14
STATE = "place binary, moved binary, squares binary"


@dataclass(frozen=True)
class Settings:
    """The sample learned from has at most ``rows`` labelled rows, of texts up to ``longest`` characters.

    In each round every shard takes so many ``turns`` over its rows before states are averaged.
    """

    rows: int = 32_000
    longest: int = 50_000
    shard_rows: int = 2_000
    rounds: int = 2
    turns: int = 2
    bits: int = 18
    orders: tuple[int, ...] = (1, 2)
    rate: float = 1.0
    beta: float = 1.0
    lasso: float = 0.05
    ridge: float = 0.02

    @property
    def places(self) -> int:
        """One per hash, then the share of repeated n-grams per order, then the constant."""
        return (1 << self.bits) + len(self.orders) + 1


# what a byte belongs to: a word, white space, or runs of the same sign
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[c for c in range(256) if chr(c).isalnum() or c >= 128]] = 1
_KIND[list(SPACES)] = 0


def features(parts: list[str], settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: places, values, and where each text's part of them begins (one more for the end).

    Values grow with the logarithm of the count, and the hashed ones of a text have length 1.
    A text's features do not depend on its neighbours.  A place may come twice, if hashes meet.
    """
    if len(parts) >= 1 << 20:
        raise ValueError("too many texts at once")
    encoded = [p.encode("utf-8", "replace") for p in parts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    start, end = change[:-1], change[1:]
    inside = kind[start] != 0
    start, end = start[inside], end[inside]
    words = PrefixHash(data).of(start, end)
    owner = np.searchsorted(np.cumsum([len(p) + 1 for p in encoded]), start, side="right").astype(np.uint64)
    n = len(parts)
    keys, places, repeats = [], 1 << settings.bits, np.zeros((len(settings.orders), n))
    for k, order in enumerate(settings.orders):
        last = max(len(words) - order + 1, 0)
        rolled = np.full(last, np.uint64(order))
        for j in range(order):
            rolled = rolled * _STEP + words[j:last + j]
        whole = owner[:last] == owner[len(words) - last:]
        own = (owner[:last] << np.uint64(44) | spread(rolled) >> np.uint64(20))[whole]
        distinct, count = np.unique(own, return_counts=True)
        who = (distinct >> np.uint64(44)).astype(np.int64)
        total = np.bincount(who, count, n)
        repeats[k] = 1 - np.bincount(who, minlength=n) / np.maximum(total, 1)
        repeats[k][total == 0] = 0
        keys.append((who, (distinct & np.uint64(places - 1)).astype(np.int64), np.log1p(count)))
    who, place, value = (np.concatenate(p) for p in zip(*keys))
    value = value / np.sqrt(np.bincount(who, value * value, n))[who]
    extra = len(settings.orders)
    who = np.concatenate([who, np.tile(np.arange(n), extra + 1)])
    place = np.concatenate([place, np.repeat(places + np.arange(extra + 1), n)])
    value = np.concatenate([value, repeats.ravel(), np.ones(n)])
    order = np.argsort(who, kind="stable")
    return place[order], value[order], np.searchsorted(who[order], np.arange(n + 1))


class Leader:
    """State of the updates: per place the sum of gradients, moved, and of their squares."""

    def __init__(self, settings: Settings, moved: np.ndarray | None = None, squares: np.ndarray | None = None):
        self.settings = settings
        self.moved = np.zeros(settings.places) if moved is None else moved
        self.squares = np.zeros(settings.places) if squares is None else squares

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        s, z = self.settings, self.moved[at]
        size = np.maximum(np.abs(z) - s.lasso, 0)
        return -np.sign(z) * size / ((s.beta + np.sqrt(self.squares[at])) / s.rate + s.ridge)

    def learn(self, place: np.ndarray, value: np.ndarray, y: float) -> None:
        """One row; its places are distinct."""
        w = self.weights(place)
        gradient = (_sigmoid(w @ value) - y) * value
        squares = self.squares[place] + gradient * gradient
        self.moved[place] += gradient - (np.sqrt(squares) - np.sqrt(self.squares[place])) / self.settings.rate * w
        self.squares[place] = squares


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    """Weights per place."""

    weights: np.ndarray
    settings: Settings

    def scores(self, parts: list[str]) -> np.ndarray:
        """The score of each text; an empty one has the constant's."""
        place, value, begins = features(parts, self.settings)
        return _sigmoid(np.add.reduceat(self.weights[place] * value, begins[:-1]))


def sampled_labels(labels: DataFrame, column: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, y, rank`` of the rows that may be learned from, at most ``rows``, by a hash of the id.

    Only ids whose crc32 leaves a remainder modulo 5 count.  An id labelled twice counts by its
    largest label; rows without id or label do not count.
    """
    known = labels.where((fold("doc_id", 5) != 0) & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("double").alias("y"))
    rank = F.xxhash64(F.col("doc_id").cast("long"), F.lit(12))
    return known.withColumn("rank", rank).orderBy("rank", "doc_id").limit(settings.rows)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", settings: Settings = Settings()) -> Model:
    """Learn from a bounded sample of labelled rows, in shards of about ``shard_rows`` rows.

    Rows of one id are all learned from; their order, and with it the model, does not depend on the
    partitions.  Without any row to learn from every score is 0.5.
    """
    chosen = F.broadcast(sampled_labels(labels, column, settings))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= settings.longest).join(chosen, "doc_id")
    rows = save(known.select("y", "rank", F.xxhash64("text").alias("digest"), "text"), "labelled")
    shards = max(1, round(rows.count() / settings.shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("rank", "digest"), F.lit(shards)).cast("int"))
    leader = Leader(settings)
    for _ in range(settings.rounds):
        states = dealt.groupBy("shard").applyInPandas(_learned(leader), f"block int, shard int, {STATE}")
        # states are averaged block by block on the executors: the driver gets one state, however many shards there are
        means = states.groupBy("block").applyInPandas(_averaged, STATE).collect()
        leader = Leader(settings, leader.moved.copy(), leader.squares.copy())
        for r in means:
            place = np.frombuffer(r.place, np.int32)
            leader.moved[place], leader.squares[place] = np.frombuffer(r.moved), np.frombuffer(r.squares)
    return Model(leader.weights(), settings)


def _learned(start: Leader):
    """Some turns over the rows of a shard, and the state of the places they touched."""
    settings = start.settings

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "digest"], kind="stable")
        own, learned = Leader(settings, start.moved.copy(), start.squares.copy()), []
        for low in range(0, len(rows), 100):
            part = rows.iloc[low:low + 100]
            place, value, begins = features(part.text.tolist(), settings)
            for lo, hi, y in zip(begins, begins[1:], part.y):
                distinct, inverse = np.unique(place[lo:hi], return_inverse=True)
                learned.append((distinct.astype(np.int32), np.bincount(inverse, value[lo:hi]).astype(np.float32), y))
        for _ in range(settings.turns):
            for row in learned:
                own.learn(*row)
        place = np.flatnonzero(own.squares != start.squares).astype(np.int32)
        block = place // BLOCK
        cuts = np.searchsorted(block, np.arange(settings.places // BLOCK + 2)).tolist()
        out = []
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo < hi:
                at = place[lo:hi]
                out.append((b, rows.shard.iloc[0], at.tobytes(), own.moved[at].tobytes(), own.squares[at].tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "place", "moved", "squares"])
    return run


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean state of the places of a block, each over the shards that touched it, added up in the order of shards."""
    first = rows["block"].iloc[0] * BLOCK
    moved, squares, touched = (np.zeros(BLOCK) for _ in range(3))
    for r in rows.sort_values("shard", kind="stable").itertuples():
        at = np.frombuffer(r.place, np.int32) - first
        touched[at] += 1
        moved[at] += np.frombuffer(r.moved)
        squares[at] += np.frombuffer(r.squares)
    at = np.flatnonzero(touched)
    state = (at + first).astype(np.int32), moved[at] / touched[at], squares[at] / touched[at]
    return pd.DataFrame([tuple(x.tobytes() for x in state)], columns=["place", "moved", "squares"])


def classified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; a NULL text is empty, a NULL id not held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts(batch)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on ``labels.quality`` and score every whole text.  Repeated rows come repeatedly; an empty table gives none.

    Neither labels nor language, source or id are inputs of a score, nor are columns beside ``text``.
    """
    return classified(docs, fit(docs, labels, "quality", settings))
