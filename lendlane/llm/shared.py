"""Helpers the operators have in common: shared files, text batches, word masks, components.

Rows with a NULL text count as empty texts.  Operators pick the columns they name and
never touch others; those that hand on all columns name their own by ``free_names``.  So further
columns, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The word pattern and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the documents, pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each made longer until no column is called so, in whatever case."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def quoted(names: Sequence[str]) -> list[str]:
    """Column names as they can be selected, dots and backticks included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def n_words(text: str | Column) -> Column:
    """Number of words; NULL counts as none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(ids: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col(ids).cast("string").cast("binary")) % divisor


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, NULL as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring values come out unrelated.  Defined modulo 2^64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHash:
    """Hashes of any byte ranges of a buffer in constant time each, by prefix sums modulo 2^64.

    Long ranges of regular texts can meet, however they were made: use it for ranges of some 64 bytes, or
    where meeting costs time only.
    """

    _table = spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    _base, _inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._down = _powers(self._inverse, n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._table[data] * _powers(self._base, n), out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spread((self._sums[end] - self._sums[start]) * self._down[start])


KEPT_POWERS = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; a worker keeps a bounded number of them from call to call."""
    if n > KEPT_POWERS:
        return _made_powers(base, n)
    have = _kept.get(int(base))
    if have is None or len(have) < n:
        have = _kept[int(base)] = _made_powers(base, min(max(2 * n, 1 << 12), KEPT_POWERS))
        have.flags.writeable = False
    return have[:n]


def _made_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, int(base)
    while have < n:
        out[have:2 * have] = out[:min(have, n - have)] * np.uint64(step)
        have, step = 2 * have, step * step % (1 << 64)
    return out[:n]


LONGEST_HASHED = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a buffer; long ones by a digest of their bytes."""
    out = PrefixHash(data).of(start, end)
    for i in np.flatnonzero(end - start > LONGEST_HASHED):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a UTF-8 buffer."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list and the smallest node each is connected to."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)  # also what stands for the node
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


EDGES_PER_TASK = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: ``(node, component)`` with the smallest node as component.

    Each task joins its own edges, a bounded number, to stars; what is left of several tasks is
    joined by large-star and small-star steps until nothing changes.  Joins are forced to shuffle
    both sides, so adaptive execution can split a node with very many edges.  Nodes without an
    edge do not occur; edges with a NULL end are ignored.
    """
    edges = save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = None
    for _ in range(rounds):
        tasks = -(-edges.count() // EDGES_PER_TASK)
        edges = save(edges.coalesce(max(tasks, 1)).mapInPandas(_stars, "u long, v long"), "stars")
        if tasks <= 1:  # one task has seen every edge that is left
            break
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.union(edges.select("v", "u"))
        edges = save(_to_least(both, F.col("v") > F.col("u")), "large")
        edges = save(_to_least(edges, F.lit(True)), "small")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task, each component as a star around its smallest node."""
    parts = list(parts)
    if parts:
        node, least = local_components(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in ("u", "v")))
        yield pd.DataFrame({"u": node[node != least], "v": least[node != least]})


def _to_least(edges: DataFrame, kept: Column) -> DataFrame:
    """Link each kept neighbour of a node, and the node itself, to the least node around it."""
    even = F.pmod(F.xxhash64("u"), F.lit(1).cast("bigint"))  # one more key, so that both sides are shuffled
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = edges.where(kept).withColumn("_even", even).join(least.withColumn("_even", even), ["u", "_even"])
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
