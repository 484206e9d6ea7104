"""Best-fit packing of documents into sequences under several capacities at once.

Documents become pieces of at most one sequence.  Pieces are dealt to groups of bounded size;
in a group they go, longest first, to the open sequence that their weighted sizes fit best.
Sequences left with much room are opened again and packed once more across groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import save, slices, texts
from lendlane.llm.wordpieces import word_encoder


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold: tokens, pieces, and attention cost (the sum of squared piece lengths).

    ``weights`` weigh the three in choosing a sequence; ``choose`` is ``norm`` for the least weighted
    norm of what is left, ``dot`` for the largest weighted dot-product of piece and room.  Defaults
    of pieces and cost never bind, as a sequence of 2048 tokens cannot exceed them.
    """

    tokens: int = 2048
    pieces: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    choose: str = "norm"
    group: int = 2048
    reopen: float = 0.03


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, longest: int, end_id: int = 0) -> DataFrame:
    """Token pieces of every text: its ids and ``end_id``, cut every ``longest`` tokens.

    A NULL or empty text is one piece of ``end_id``.  Every row is a document of its own.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts(batch))):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * longest)):
                    own = ids[at:at + 4 * longest]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def vector_best_fit(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; longest pieces are placed first.

    A piece goes to the open sequence with room in every capacity that scores best, the earliest
    of equals, else to a new one.
    """
    if len(lengths) and (lengths.max() > caps.tokens or lengths.max() ** 2 > caps.cost or caps.pieces < 1):
        raise ValueError("a piece is larger than a sequence may be")
    w_tokens, w_pieces, w_cost = caps.weights
    by_norm = caps.choose == "norm"
    stops = by_norm and min(caps.weights) >= 0
    # open sequences by their room: tokens, number, pieces, cost
    live: list[tuple[int, int, int, int]] = []
    bins, smallest = 0, int(lengths.min()) if len(lengths) else 0
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        best = None
        for place in range(bisect_left(live, (n,)), len(live)):
            tokens, k, rest, cost = live[place]
            own = w_tokens * ((tokens - n) / caps.tokens) ** 2
            if stops and best and own > best[0]:  # the other two only add to it, and room only grows
                break
            if rest < 1 or cost < n * n:
                continue
            if by_norm:
                score = own + w_pieces * ((rest - 1) / caps.pieces) ** 2 + w_cost * ((cost - n * n) / caps.cost) ** 2
            else:
                score = -(w_tokens * (tokens / caps.tokens) * (n / caps.tokens) + w_pieces * (rest / caps.pieces) * (1 / caps.pieces)
                          + w_cost * (cost / caps.cost) * (n * n / caps.cost))
            if best is None or (score, k) < best[:2]:
                best = score, k, place
        if best:
            tokens, k, rest, cost = live.pop(best[2])
        else:
            tokens, k, rest, cost = caps.tokens, bins, caps.pieces, caps.cost
            bins += 1
        number[item], offset[item] = k, caps.tokens - tokens
        if tokens - n >= smallest and rest > 1:  # else nothing fits any more
            insort(live, (tokens - n, k, rest - 1, cost - n * n))
    return number, offset


def packed(parts: DataFrame, caps: Capacities = Capacities()) -> DataFrame:
    """``parts`` (with ``length``) and the ``sequence_id`` and ``offset`` of each row; empty stays empty.

    Groups take about ``caps.group`` pieces, dealt by row number, so equal rows spread too.
    """
    parts = save(parts, "pieces")
    first = save(_grouped(parts, caps, 0), "packed")
    held = first.groupBy("sequence_id").agg(F.sum("length").alias("_held"))
    loose = held.where(F.col("_held") < caps.tokens * (1 - caps.reopen)).select("sequence_id")
    again = save(first.join(loose, "sequence_id", "left_semi").drop("sequence_id", "offset"), "loose")
    second = _grouped(again, caps, 1)
    return first.join(loose, "sequence_id", "left_anti").select(*second.columns).union(second)


def _grouped(parts: DataFrame, caps: Capacities, turn: int) -> DataFrame:
    groups = max(1, -(-parts.count() // caps.group))
    named = [f"`{c}`" for c in parts.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["_group"].iloc[0])
        number, offset = vector_best_fit(rows["length"].to_numpy(), caps)
        return rows.drop(columns="_group").assign(sequence_id=number + ((2 * group + turn) << 32), offset=offset)

    dealt = parts.select(*named, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, caps: Capacities = Capacities()) -> DataFrame:
    """Whole documents as pieces in sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return packed(pieces(docs, tokenizer, caps.tokens), caps)
