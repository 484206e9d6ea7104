"""Language-model scores by logistic context mixing over the bits of bytes.

Six predictors look up hashed contexts of the last 0 to 5 bytes and the bits of the byte so far.
Their stretched probabilities are combined by weights that a gate selects, the result is refined
by an adaptive table, and the logarithms add up to the score of a text.

Learning is online, in mini-batches, and distributed.  The corpus is gathered as distinct strings
of six bytes with counts, dealt to buckets by the last two bytes before the coded one, so that all
longer contexts of a byte meet in one bucket.  Buckets learn weights in turns that are averaged.
Every occurrence is predicted without itself while learning.  The model is frozen for scoring, so
a score does not depend on the order or place of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import fold, save, spread, word_hashes, word_ranges

ORDER = 5
END = 0xFF  # occurs in no UTF-8 text; stands before and after each
END_WORD = np.uint64(0x0E0D)
SLICE = 2_000_000


@dataclass(frozen=True)
class Settings:
    turns: int = 2
    batch: int = 8192
    rate: float = 0.3
    buckets: int = 64
    steps: int = 24
    documents: int = 4000


@dataclass(frozen=True)
class Weights:
    """Counts of bytes after one byte, mixing weights per gate, and the refining table."""

    pairs: np.ndarray
    mix: np.ndarray
    refine: np.ndarray | None = None


GATES = 24
INPUTS = ORDER + 2  # six predictors and a constant


# ---------------------------------------------------------------- texts to numbers

def _slices(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    own, size, at = [], 0, 0
    for k, text in enumerate(texts):
        own.append((text or "").encode("utf-8", "replace").lower())
        size += len(own[-1])
        if size >= SLICE:
            yield at, own
            own, size, at = [], 0, k + 1
    if own:
        yield at, own


def strings(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte strings that end at every byte and at the end of each text, and their texts."""
    pad, end = bytes([END]) * ORDER, bytes([END])
    data = np.frombuffer(b"".join(pad + r + end for r in raw), np.uint8)
    sizes = np.array([len(r) + ORDER + 1 for r in raw])
    text = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        key = (key << np.uint64(8)) | data[k:len(data) - ORDER + k]
    keep = place[ORDER:] >= ORDER
    return key[keep], text[ORDER:][keep]


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and their texts."""
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    start, end = word_ranges(data)
    ends = np.cumsum([len(r) + 1 for r in raw])
    text = np.searchsorted(ends, start, side="right")
    return (np.append(word_hashes(data, start, end), np.full(len(raw), END_WORD)), np.append(text, np.arange(len(raw))))


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    numbers, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(numbers, kind="stable")
    numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else np.zeros(0, np.int64)
    return numbers[first], np.add.reduceat(counts, first) if len(first) else counts


def _found(numbers: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each of the asked numbers stands among ascending ones; looked up in ascending order, so that the search stays in caches."""
    order = np.argsort(asked)
    out = np.empty(len(asked), np.int64)
    out[order] = np.searchsorted(numbers, asked[order])
    return out


def _bucket(kind: str, numbers: np.ndarray, buckets: int) -> np.ndarray:
    key = numbers if kind == "word" else (numbers >> np.uint64(8)) & np.uint64(0xFFFF)
    return (spread(key + np.uint64(5)) >> np.uint64(33)) % np.uint64(buckets)


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze(values: np.ndarray, kind: str) -> bytes:
    raw = values.astype(kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes())


def _swell(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


ASKED = "kind string, bucket int, chunk int, numbers binary, counts binary, total long"


def _distinct(texts: list[str], learns: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words or strings of a chunk, and how often those that learn hold them."""
    parts = []
    for at, raw in _slices(texts):
        numbers, text = (words if kind == "word" else strings)(raw)
        uses = learns[at:at + len(raw)][text]
        values, n = np.unique(numbers[uses], return_counts=True)
        parts.append((values, n))
        if not uses.all():
            others = np.unique(numbers[~uses])
            parts.append((others, np.zeros(len(others), np.int64)))
    return _counted(parts)


def _asked(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    out, texts = [], rows["text"].tolist()
    for kind in ("word", "string"):
        numbers, counts = _distinct(texts, rows["learns"].to_numpy(bool), kind)
        bucket = _bucket(kind, numbers, buckets)
        for b in np.unique(bucket):
            own = bucket == b
            out.append((kind, int(b), int(rows["chunk"].iloc[0]), _pack(numbers[own]), _squeeze(counts[own], "<i8"), int(counts[own].sum())))
    return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "numbers", "counts", "total"])


ANSWERS = "kind string, bucket int, chunk int, answers binary, known long"


def _word_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the corpus counts of its words, in their order; one row tells the vocabulary."""
    asked = [_unpack(x) for x in rows["numbers"]]
    numbers, counts = _counted(list(zip(asked, [_swell(x, "<i8") for x in rows["counts"]])))
    out = [("word", b, c, _squeeze(counts[np.searchsorted(numbers, own)], "<i8"), 0) for b, c, own in zip(rows["bucket"], rows["chunk"], asked)]
    out.append(("size", int(rows["bucket"].iloc[0]), -1, b"", int((counts > 0).sum())))
    return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "answers", "known"])


def _gathered(rows: pd.DataFrame) -> pd.DataFrame:
    numbers, counts = _counted(list(zip([_unpack(x) for x in rows["numbers"]], [_swell(x, "<i8") for x in rows["counts"]])))
    return pd.DataFrame([(int(rows["bucket"].iloc[0]), _pack(numbers), _squeeze(counts, "<i8"))], columns=["bucket", "numbers", "counts"])


# ---------------------------------------------------------------- the predictors

class Bucket:
    """The strings of a bucket, and the counts of bits after their hashed contexts."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.numbers, self.counts = numbers, counts
        self._size = 1 << (8 * max(len(numbers), 16) - 1).bit_length()
        self._pairs = _bit_counts(pairs)
        byte, seen = (numbers & np.uint64(255)).astype(np.int64), counts > 0
        self._tables = []
        for k in range(2, ORDER + 1):
            table = np.zeros((2, self._size))
            for j in range(8):
                slot = self._slots(numbers[seen], k, j)
                bit = (byte[seen] >> (7 - j)) & 1
                for b in (0, 1):
                    table[b] += np.bincount(slot[bit == b], counts[seen][bit == b], self._size)
            self._tables.append(table)

    def _slots(self, numbers: np.ndarray, order: int, j: int) -> np.ndarray:
        context = (numbers >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
        node = (np.uint64(1) << np.uint64(j)) | ((numbers & np.uint64(255)) >> np.uint64(8 - j))
        return (spread(context * np.uint64(256) + node) & np.uint64(self._size - 1)).astype(np.int64)

    def inputs(self, numbers: np.ndarray, j: int, left_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions of bit ``j`` and the gate; ``left_out`` takes one occurrence away."""
        byte = (numbers & np.uint64(255)).astype(np.int64)
        node = (1 << j) | (byte >> (8 - j))
        bit = (byte >> (7 - j)) & 1
        before = ((numbers >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        pairs = self._pairs
        counted = [(pairs[0].sum(axis=0)[node], pairs[1].sum(axis=0)[node]), (pairs[0][before, node], pairs[1][before, node])]
        for k, table in zip(range(2, ORDER + 1), self._tables):
            slot = self._slots(numbers, k, j)
            counted.append((table[0][slot], table[1][slot]))
        x = np.empty((len(numbers), INPUTS))
        x[:, -1] = 0.3
        longest, held = np.zeros(len(numbers), np.int64), np.zeros(len(numbers))
        for k, (n0, n1) in enumerate(counted):
            if left_out is not None:
                n0, n1 = np.maximum(n0 - left_out * (bit == 0), 0), np.maximum(n1 - left_out * (bit == 1), 0)
            n = n0 + n1
            x[:, k] = np.log((n1 + 0.02) / (n0 + 0.02)) * (n / (n + 4))  # less of it where little was seen
            longest[n > 0], held = k, np.where(n > 0, n, held)
        gate = longest * 4 + np.clip(np.log2(held + 1) / 2, 0, 3).astype(np.int64)
        return x, gate


def _bit_counts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 bits per byte before and node of the bits so far."""
    out = np.zeros((2, 256, 256))
    byte = np.arange(256)
    for j in range(8):
        node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
        for b in (0, 1):
            np.add.at(out[b].T, node[bit == b], pairs.T[bit == b])
    return out[0], out[1]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _mixed(x: np.ndarray, gate: np.ndarray, mix: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ni,ni->n", x, mix[gate]), -12, 12)


def _cell(s: np.ndarray, gate: np.ndarray, steps: int) -> np.ndarray:
    return gate * steps + np.clip((s + 12) * steps / 24, 0, steps - 1).astype(np.int64)


def _learned(bucket: Bucket, weights: Weights, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one pass of mini-batches over the strings of a bucket, and the mass per gate."""
    seen = np.flatnonzero(bucket.counts > 0)
    order = seen[np.argsort(spread(bucket.numbers[seen]), kind="stable")]  # a repeatable shuffle
    mix, mass = weights.mix.copy(), np.zeros(GATES)
    for at in range(0, len(order), settings.batch):
        own = order[at:at + settings.batch]
        numbers, n = bucket.numbers[own], bucket.counts[own].astype(float)
        for j in range(8):
            x, gate = bucket.inputs(numbers, j, np.ones(len(own)))
            bit = ((numbers >> np.uint64(7 - j)) & np.uint64(1)).astype(float)
            p = _squash(_mixed(x, gate, mix))
            mass += np.bincount(gate, n, GATES)
            for i in range(INPUTS):
                up = np.bincount(gate, n * (bit - p) * x[:, i], GATES)
                curve = np.bincount(gate, n * p * (1 - p) * x[:, i] ** 2, GATES)
                total = np.bincount(gate, n, GATES)
                mix[:, i] += settings.rate / INPUTS * up / (curve + 0.02 * total + 1)
    return mix, mass


def _refined(s: np.ndarray, gate: np.ndarray, weights: Weights, steps: int) -> np.ndarray:
    """Half the mixed probability, half what the table says of its like."""
    p = _squash(s)
    if weights.refine is None:
        return p
    ones, total = weights.refine[:, _cell(s, gate, steps)]
    return (p + (ones + 20 * p) / (total + 20)) / 2


def log_probabilities(bucket: Bucket, numbers: np.ndarray, weights: Weights, settings: Settings) -> np.ndarray:
    """log10 of the probability of the last byte of each string after the five before it."""
    out = np.zeros(len(numbers))
    for j in range(8):
        x, gate = bucket.inputs(numbers, j)
        p = np.clip(_refined(_mixed(x, gate, weights.mix), gate, weights, settings.steps), 1e-7, 1 - 1e-7)
        bit = (numbers >> np.uint64(7 - j)) & np.uint64(1)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


# ---------------------------------------------------------------- learning on Spark

def _each(table: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the strings of every bucket: one row in, some rows out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for numbers, counts in zip(rows["numbers"], rows["counts"]):
                yield work(_unpack(numbers), _swell(counts, "<i8"))

    return table.select("numbers", "counts").mapInPandas(run, schema)


def _pairs(table: DataFrame) -> np.ndarray:
    def work(numbers, counts):
        pair = (numbers & np.uint64(0xFFFF)).astype(np.int64)
        n = np.bincount(pair, counts, 1 << 16)
        at = np.flatnonzero(n)
        return pd.DataFrame({"at": at, "n": n[at].astype(np.int64)})

    out = np.zeros(1 << 16)
    for r in _each(table, work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out.reshape(256, 256)


def learn(table: DataFrame, settings: Settings) -> Weights:
    """Turns of online learning in all buckets, averaged by mass, then the refining table.

    What comes to the driver has a fixed size: counts per pair of bytes, sums per gate and cell.
    """
    pairs = _pairs(table)
    weights = Weights(pairs, np.full((GATES, INPUTS), 0.3))
    for _ in range(settings.turns):
        def turn(numbers, counts, weights=weights):
            mix, mass = _learned(Bucket(numbers, counts, weights.pairs), weights, settings)
            gate, i = np.divmod(np.arange(GATES * INPUTS), INPUTS)
            return pd.DataFrame({"at": np.arange(GATES * INPUTS), "sum": mix.ravel() * mass[gate], "mass": mass[gate]})

        mix = weights.mix.ravel().copy()
        for r in _each(table, turn, "at long, sum double, mass double").groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("mass").alias("mass")).collect():
            if r.mass:
                mix[r["at"]] = r["sum"] / r.mass
        weights = Weights(pairs, mix.reshape(GATES, INPUTS).round(9))

    def cells(numbers, counts):
        bucket, seen = Bucket(numbers, counts, pairs), counts > 0
        ones, total = np.zeros((2, GATES * settings.steps))
        for at in range(0, int(seen.sum()), 1 << 17):
            own, n = numbers[seen][at:at + (1 << 17)], counts[seen][at:at + (1 << 17)].astype(float)
            for j in range(8):
                x, gate = bucket.inputs(own, j, np.ones(len(own)))
                cell = _cell(_mixed(x, gate, weights.mix), gate, settings.steps)
                bit = ((own >> np.uint64(7 - j)) & np.uint64(1)).astype(float)
                ones += np.bincount(cell, n * bit, len(ones))
                total += np.bincount(cell, n, len(ones))
        return pd.DataFrame({"at": np.arange(len(ones)), "ones": ones.astype(np.int64), "total": total.astype(np.int64)})

    refine = np.zeros((2, GATES * settings.steps))
    for r in _each(table, cells, "at long, ones long, total long").groupBy("at").agg(F.sum("ones").alias("ones"), F.sum("total").alias("total")).collect():
        refine[:, r["at"]] = r.ones, r.total
    return Weights(pairs, weights.mix, refine)


def _answered(asked: pd.DataFrame, table: pd.DataFrame, weights: Weights, settings: Settings) -> pd.DataFrame:
    """For each chunk the log-probabilities of its strings, in their order."""
    if not len(asked):
        return pd.DataFrame(columns=["kind", "bucket", "chunk", "answers", "known"])
    numbers, counts = _unpack(table["numbers"].iloc[0]), _swell(table["counts"].iloc[0], "<i8")
    bucket = Bucket(numbers, counts, weights.pairs)
    parts = [log_probabilities(bucket, numbers[at:at + (1 << 17)], weights, settings) for at in range(0, len(numbers), 1 << 17)]
    values = np.concatenate(parts)
    out = [("string", b, c, _squeeze(values[np.searchsorted(numbers, _unpack(own))], "<f4"), 0)
           for b, c, own in zip(asked["bucket"], asked["chunk"], asked["numbers"])]
    return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "answers", "known"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _scored(rows: pd.DataFrame, answers: pd.DataFrame, total: int, known: int, buckets: int) -> pd.DataFrame:
    texts = rows["text"].tolist()
    numbers, values = {}, {}
    for kind, form in (("word", "<i8"), ("string", "<f4")):
        numbers[kind] = _distinct(texts, np.ones(len(texts), bool), kind)[0]
        bucket, own = _bucket(kind, numbers[kind], buckets), answers[answers["kind"] == kind]
        values[kind] = np.zeros(len(numbers[kind]), form)
        for b, data in zip(own["bucket"], own["answers"]):
            values[kind][bucket == np.uint64(b)] = _swell(data, form)
    out = {k: [] for k in ("n_tokens", "n_known", "base", "score")}
    per_word = np.log10((values["word"] + 1) / (total + known + 1))
    for _, raw in _slices(texts):
        n = len(raw)
        word, text = words(raw)
        at = _found(numbers["word"], word)
        out["n_tokens"].append(np.bincount(text, minlength=n))
        out["n_known"].append(np.bincount(text, values["word"][at] > 0, n).astype(np.int64))
        out["base"].append(np.bincount(text, per_word[at], n))
        string, text = strings(raw)
        out["score"].append(np.bincount(text, values["string"][_found(numbers["string"], string)].astype(float), n))
    return pd.DataFrame({"doc_id": rows["doc_id"], "held_out": rows["held_out"], **{k: np.concatenate(v) for k, v in out.items()}})


def scored(docs: DataFrame, ids: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Ids whose crc32 leaves the remainder 2 modulo 7 are held out, all others learn; rows without an
    id do neither.  NULL texts are empty: one token, the end.  ``score`` is the log10 probability of
    the bytes of the text, A-Z lower-cased, and of its end.  Equal texts get equal scores.
    """
    remainder = fold(ids, 7)
    docs = docs.select(
        F.col(ids).cast("long").alias("doc_id"), "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
        F.coalesce(remainder != 2, F.lit(False)).alias("learns"))
    chunks, buckets = max(24, docs.count() // settings.documents), settings.buckets
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = save(dealt.groupBy("chunk").applyInPandas(lambda rows: _asked(rows, buckets), ASKED), "asked")

    of_words = save(asked.where("kind = 'word'").groupBy("bucket").applyInPandas(_word_counts, ANSWERS), "words")
    total = asked.where("kind = 'word'").agg(F.sum("total")).first()[0] or 0
    known = of_words.where("kind = 'size'").agg(F.sum("known")).first()[0] or 0

    of_strings = asked.where("kind = 'string'")
    table = save(of_strings.groupBy("bucket").applyInPandas(_gathered, "bucket int, numbers binary, counts binary"), "strings")
    weights = docs.sparkSession.sparkContext.broadcast(learn(table.repartition(buckets), settings))
    answers = of_strings.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(
        lambda left, right: _answered(left, right, weights.value, settings), ANSWERS)
    answers = save(answers.union(of_words.where("kind = 'word'")), "answers")

    result = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda rows, own: _scored(rows, own, total, known, buckets), SCORED)
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
