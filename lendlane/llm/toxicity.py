"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text is cut into windows of a few words.  A window that gets shorter with the toxic dictionary
at hand than with the ordinary one alone speaks for toxicity.  Both compressors share the ordinary
dictionary, so windows without toxic content come out equally long, whatever they hold.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from lendlane.llm.shared import fold, free_names, quoted, save, slices, texts

LIMIT = 0.3


@dataclass(frozen=True)
class Settings:
    """``toxic_rows`` and ``ordinary_rows`` bound the labelled sample the model is fitted on."""

    toxic_rows: int = 4000
    ordinary_rows: int = 8000
    sample_chars: int = 24_000_000
    window: int = 12
    level: int = 12
    toxic_bytes: int = 4096
    ordinary_bytes: int = 32768
    parts: int = 3
    shared: float = 0.015
    steps: tuple[int, ...] = (2, 3, 4, 5, 6)


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration of the counts of windows by saved bytes."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    settings: Settings

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    """Compressors of one task."""

    def __init__(self, model: Model):
        self.settings, self.weights = model.settings, np.array(model.weights)
        with_toxic = [model.ordinary] if not model.toxic else [model.toxic + model.ordinary]
        self._plain, self._toxic = (_compressor(d, model.settings.level) for d in (model.ordinary, with_toxic[0]))

    def features(self, text: str) -> np.ndarray:
        """Counts of windows that save at least so many bytes, the best saving and the length."""
        plain, toxic, words, k = self._plain, self._toxic, text.lower().split(), self.settings.window
        saved = []
        for i in range(0, len(words), k):
            window = f" {' '.join(words[i:i + k])} ".encode("utf-8", "replace")
            saved.append(len(plain(window)) - len(toxic(window)))
        saved = np.array(saved or [0])
        counts = [math.log1p(int((saved >= s).sum())) for s in self.settings.steps]
        return np.array([1.0, *counts, min(max(int(saved.max()), 0), 12) / 4, math.log1p(len(saved)) / 4])

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.features(text) @ self.weights, -30, 30))))


def _compressor(content: bytes, level: int):
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False).compress
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_dict_id=False).compress


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; too few samples are taken as they are."""
    random.Random(7).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the texts of a bounded sample of labelled rows; rows are calibrated with dictionaries they had no part in.

    The texts of the sample come to the driver as far as they stay under ``sample_chars`` per label,
    in the order of a hash of the id; a text that does not fit is passed over.  Without a toxic row the
    score of every text is a constant 0.  Raises if there are rows of a label but none fits.
    """
    chosen = F.broadcast(sampled_labels(labels, settings))
    known = save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").distinct(), "labelled")
    rows, text = [], F.xxhash64("text").alias("key")
    for label in (1, 0):
        own = known.where(F.col("toxic") == label)
        left, fits, sizes = settings.sample_chars // 2, [], own.groupBy("rank", text).agg(F.sum(F.length("text")).alias("n"))
        for r in sizes.orderBy("rank", "key").toLocalIterator():
            if r.n <= left:
                left -= r.n
                fits.append((r["rank"], r.key))
        if fits:
            taken = F.broadcast(docs.sparkSession.createDataFrame(fits, "rank long, key long"))
            rows += own.withColumn("key", text).join(taken, ["rank", "key"], "left_semi").orderBy("rank", "text").collect()
        elif not own.isEmpty():
            raise ValueError(f"no text labelled toxic = {label} fits into {settings.sample_chars // 2} characters")
    parts = [zlib.crc32(f"{r.doc_id}/part".encode()) % settings.parts for r in rows]
    if not any(r.toxic for r in rows):
        return Model(b"", b"", (-30.0,) + (0.0,) * (len(settings.steps) + 2), settings)
    x, y = [], []
    for part in range(settings.parts):
        own = Model(*_dictionaries([(r.toxic, r.text.lower()) for r, p in zip(rows, parts) if p != part], settings), (), settings).scorer()
        for r, p in zip(rows, parts):
            if p == part:
                x.append(own.features(r.text))
                y.append(float(r.toxic))
    dictionaries = _dictionaries([(r.toxic, r.text.lower()) for r in rows], settings)
    return Model(*dictionaries, tuple(_logistic(np.array(x), np.array(y))), settings)


def _strings(text: str) -> set[str]:
    """The words of a text and their beginnings of four characters and more."""
    words = set(text.split())
    return words | {w[:k] for w in words for k in range(4, min(len(w), 9))}


def _dictionaries(build: list[tuple[int, str]], settings: Settings) -> tuple[bytes, bytes]:
    """The toxic dictionary is trained on words and stems that toxic texts share and ordinary ones lack.

    Strings shared by few texts are left out, so that copies of one toxic text do not fill it.
    """
    toxic, ordinary = ([t for label, t in sorted(set(build)) if label == kind] for kind in (1, 0))
    held = Counter(s for t in toxic for s in _strings(t))
    least = max(3, settings.shared * len(toxic))
    held = {s: n for s, n in held.items() if n >= least}
    other = Counter(s for t in ordinary for s in _strings(t) if s in held)
    typical = {s: n for s, n in held.items() if other[s] * len(toxic) <= 0.05 * n * max(len(ordinary), 1)}
    samples = [f" {s} ".encode() for s, n in sorted(typical.items()) for _ in range(n)]
    trained = _train(samples, settings.toxic_bytes // 2, 16, 6) if samples else b""
    for string in sorted(typical, key=lambda s: (-typical[s], s)):  # what training left out, as far as there is room
        own = f" {string} ".encode()
        if own[:-1] not in trained and len(trained) + len(own) <= settings.toxic_bytes:
            trained += own
    return (
        trained,
        _train([t.encode("utf-8", "replace") for t in ordinary], settings.ordinary_bytes, 50, 8),
    )


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled_labels(labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, toxic, rank`` of the rows to learn from: at most ``toxic_rows`` and ``ordinary_rows``.

    Only ids whose crc32 leaves no remainder 2 modulo 4 count; an id labelled twice counts by its
    largest label.  Rows without id or label do not count.
    """
    known = labels.where((fold("doc_id", 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = known.withColumn("rank", F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)))
    parts = [ranked.where(F.col("toxic") == label).orderBy("rank", "doc_id").limit(most)
             for label, most in ((1, settings.toxic_rows), (0, settings.ordinary_rows))]
    return parts[0].union(parts[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1), of each whole ``text``; NULL texts are empty.

    A column of ``docs`` that is called so already, in whatever case, stays: see ``scored_as``.
    """
    return scored_as(docs, model, *free_names(docs.columns, "score"))


def scored_as(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of ``docs`` and the score under ``name``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer()
        for batch in slices(batches):
            values = pa.array([own.score(t) for t in texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; a NULL id is not held out."""
    model = fit(docs, labels, settings)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    name, = free_names(docs.columns, "score")
    return scored_as(docs, fit(docs, labels, settings), name).where(F.col(name) < LIMIT).select(*quoted(docs.columns))
