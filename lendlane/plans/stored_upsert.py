"""Upserts into a stored table: only the partitions that hold touched keys are written anew.

A table lies in buckets by a hash of its key.  An upsert reads the buckets its source touches, writes the merged rows
to a folder of its own, notes that, and then replaces just those buckets.  Run again under its name it
finishes or does nothing; files of other buckets are never opened or touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlane.operators.config import upsert
from lendlane.sources.store import Journal, checked_name, conform


@dataclass(frozen=True)
class StoredTable:
    """``schema`` declares the columns; keep ``key`` and ``buckets`` as they are for the life of a folder."""

    folder: str
    schema: str
    key: str
    buckets: int = 64

    @property
    def journal(self) -> Journal:
        return Journal(f"{self.folder}/journal")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        """One task writes a bucket; ``mode`` says whether buckets without rows are emptied."""
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)

    def create(self, rows: DataFrame) -> None:
        """Begin a table with ``rows``; columns they lack are NULL."""
        self._write(conform(rows, self.schema).withColumn("bucket", self._bucket()), f"{self.folder}/rows", "static")
        self.journal.note(rows.sparkSession, "create", "done")

    def _rows(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(f"{self.schema}, bucket int").parquet(path)

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; the others are not read."""
        rows = self._rows(spark, f"{self.folder}/rows")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))).drop("bucket")

    def _stage(self, name: str) -> str:
        return f"{self.folder}/staged/{checked_name(name)}"

    def merge(
        self, source: DataFrame, name: str, as_of, update_cols: Sequence[str],
        defaults: dict | None = None, forced: dict | None = None,
    ) -> bool:
        """``upsert`` of ``source`` into the stored rows; false if an upsert of that name was made before.

        Two source rows with one key are an error, and change nothing.  An empty source changes nothing.
        """
        return self.rewrite(source, name, lambda old: upsert(old, source, self.key, update_cols, as_of, defaults, forced))

    def rewrite(self, source: DataFrame, name: str, merged: Callable[[DataFrame], DataFrame]) -> bool:
        """Put what ``merged`` makes of the rows in the buckets of ``source`` in their place, once per ``name``."""
        spark = source.sparkSession
        self.finish(spark)
        if "done" in self.journal.of(spark, name):
            return False
        # at most as many rows as there are buckets
        touched = sorted(r.bucket for r in source.select(self._bucket()).distinct().collect())
        rows = conform(merged(self.read(spark, touched)), self.schema)
        self._write(rows.withColumn("bucket", self._bucket()), self._stage(name), "static")
        self.journal.note(spark, name, "staged")
        self._publish(spark, name)
        return True

    def _publish(self, spark: SparkSession, name: str) -> None:
        self._write(self._rows(spark, self._stage(name)), f"{self.folder}/rows", "dynamic")
        self.journal.note(spark, name, "done")

    def finish(self, spark: SparkSession) -> list[str]:
        """Finish upserts that died after their rows were staged; there is one at most."""
        names = self.journal.jobs(spark, "staged", without="done")
        for name in names:
            self._publish(spark, name)
        return names
