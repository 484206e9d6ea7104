"""What a stream must know of every booking, so stored that a micro-batch reads and moves only what it touches.

Bookings and bound sessions are tables partitioned by ``part``, a hash of the id, and bucketed by id inside.  A
batch names the parts its ids fall in, a bounded number, so the other parts are not read; and as
both tables are bucketed alike they are joined without shuffling either.

Bound sessions are written per batch: one partition ``(part, gen)`` for each part in which the batch bound
something, ``gen`` being the batch.  When a part has many, the next one holds all its sessions: a snapshot of
that part alone.  A batch reads generations before its own, and overwrites its own, so running it
again changes nothing.  What a snapshot replaced is deleted two batches later, when no rerun needs it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlane.sources.store import checked_name

COLUMNS = {
    "bookings": "id bigint, payment_status string, stripe_checkout_session_id string, part int, added string",
    "bound": "id bigint, session_id string, part int, gen bigint",
}
PARTITIONS = {"bookings": "part, added", "bound": "part, gen"}
HEADS = "part int, gens array<bigint>, replaced array<bigint>"


def overwrite_partitions(rows: DataFrame, table: str) -> None:
    """Replace those partitions of a table that ``rows`` has, and no other."""
    conf, name = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(name)
    conf.set(name, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        conf.set(name, before)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_folder(spark: SparkSession, path: str) -> None:
    system, target = _files(spark, path)
    system.delete(target, True)


@dataclass(frozen=True)
class BookingState:
    """Keep ``parts`` and ``buckets`` as they are for the life of a folder.

    ``snapshot_every`` is how many generations of a part are read at most.
    """

    folder: str
    parts: int = 64
    buckets: int = 16
    snapshot_every: int = 100

    def part(self, id: str = "id") -> Column:
        return F.pmod(F.xxhash64(F.col(id).cast("bigint")), F.lit(self.parts)).cast("int").alias("part")

    def table(self, spark: SparkSession, kind: str) -> str:
        """The name of a table; the catalog of a new session learns of the folder first."""
        name = f"{kind}_{hashlib.md5(self.folder.encode()).hexdigest()}"
        if not spark.catalog.tableExists(name):
            system, target = _files(spark, f"{self.folder}/{kind}")
            system.mkdirs(target)
            spark.sql(f"""create table if not exists {name} ({COLUMNS[kind]}) using parquet partitioned by ({PARTITIONS[kind]})
             clustered by (id) sorted by (id) into {self.buckets} buckets location '{self.folder}/{kind}'""")
            spark.sql(f"alter table {name} recover partitions")
        return name

    def forget(self, spark: SparkSession) -> None:
        """Take the tables out of the session's catalog; the files stay."""
        for kind in COLUMNS:
            spark.sql(f"drop table if exists {self.table(spark, kind)}")

    def add_bookings(self, bookings: DataFrame, name: str) -> None:
        """Store bookings under a name; storing under the same name again replaces them."""
        rows = bookings.select(
            F.col("id").cast("bigint").alias("id"), "payment_status", "stripe_checkout_session_id", self.part(),
            F.lit(checked_name(name)).alias("added"))
        overwrite_partitions(rows.repartition(self.buckets, "id"), self.table(bookings.sparkSession, "bookings"))

    def touched_parts(self, ids: DataFrame) -> list[int]:
        return sorted(r.part for r in ids.where(F.col("id").isNotNull()).select(self.part()).distinct().collect())

    def heads(self, spark: SparkSession, batch_id: int) -> dict[int, tuple[list[int], list[int]]]:
        """Per part the generations to read after a batch, and those its snapshots replaced; one row a part."""
        if batch_id < 0:
            return {}
        rows = spark.read.schema(HEADS).parquet(f"{self.folder}/heads/batch={batch_id}").collect()
        return {r.part: (r.gens, r.replaced) for r in rows}

    def bound(self, spark: SparkSession, batch_id: int, parts: Iterable[int]) -> DataFrame:
        """``id, session_id`` of bookings that batches before ``batch_id`` bound, in the given parts: one row each."""
        heads, mine = self.heads(spark, batch_id - 1), F.lit(False)
        for p in parts:
            if p in heads:
                mine = mine | ((F.col("part") == p) & F.col("gen").isin(heads[p][0]))
        return spark.table(self.table(spark, "bound")).where(mine).groupBy("id").agg(F.min("session_id").alias("session_id"))

    def after(self, ids: DataFrame, batch_id: int, bookings: DataFrame | None = None) -> DataFrame:
        """State of the bookings with these ids (each once) as the batches before ``batch_id`` left them.

        Without ``bookings`` the stored ones are used; those are not shuffled, only ``ids`` are.
        """
        spark, parts = ids.sparkSession, self.touched_parts(ids)
        wanted = ids.repartition(self.buckets, "id")
        if bookings is None:
            bookings = spark.table(self.table(spark, "bookings")).where(F.col("part").isin(parts))
        bound = self.bound(spark, batch_id, parts).select("id", F.col("session_id").alias("_session"), F.lit(True).alias("_applied"))
        return (
            bookings.select("id", "payment_status", "stripe_checkout_session_id")
            .join(wanted, "id", "left_semi")
            .join(bound, "id", "left")
            .select(
                "id",
                F.when(F.col("_applied"), "paid").otherwise(F.col("payment_status")).alias("payment_status"),
                F.when(F.col("_applied"), F.col("_session")).otherwise(F.col("stripe_checkout_session_id"))
                .alias("stripe_checkout_session_id"),
            )
        )

    def bind(self, applied: DataFrame, batch_id: int) -> None:
        """Store what a batch bound: ``id, session_id``, at most one row per booking."""
        spark, heads = applied.sparkSession, self.heads(applied.sparkSession, batch_id - 1)
        for p, (_, replaced) in heads.items():  # of the batch before, which is over for good
            for gen in replaced:
                spark.sql(f"alter table {self.table(spark, 'bound')} drop if exists partition (part={p}, gen={gen})")
                delete_folder(spark, f"{self.folder}/bound/part={p}/gen={gen}")
        now = {p: (gens, []) for p, (gens, _) in heads.items()}
        parts = self.touched_parts(applied)
        whole = [p for p in parts if p in heads and len(heads[p][0]) + 1 >= self.snapshot_every]
        rows = applied.select(F.col("id").cast("bigint").alias("id"), "session_id")
        if whole:
            rows = rows.unionByName(self.bound(spark, batch_id, whole))
        if parts:
            overwrite_partitions(
                rows.select("id", "session_id", self.part(), F.lit(batch_id).cast("bigint").alias("gen")).repartition(self.buckets, "id"),
                self.table(spark, "bound"))
        for p in parts:
            old = heads.get(p, ([], []))[0]
            now[p] = ([batch_id], old) if p in whole else ([*old, batch_id], [])
        spark.createDataFrame([(p, *gens) for p, gens in sorted(now.items())], HEADS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/heads/batch={batch_id}")
        delete_folder(spark, f"{self.folder}/heads/batch={batch_id - 2}")
