"""Folders that hold tables between runs, and a journal of what jobs have reserved and finished there.

A job that writes several tables first writes what it will add to a folder of its own, then notes that in
the journal, and only then publishes: each publishing step overwrites the same partition.  So a run that dies at any
point can be run again: before the note nothing counts, after it nothing is decided anew.  One
job at a time writes a store.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; the warehouse only where everything runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder nobody uses yet, below the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def checked_name(name: str) -> str:
    """``name``, if it can be part of a path as it is."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


@dataclass(frozen=True)
class Journal:
    """One small file per job and state, with values as JSON.  A note is there whole or not at all."""

    folder: str

    def note(self, spark: SparkSession, job: str, state: str, **values) -> None:
        row = spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.folder}/job={checked_name(job)}/state={checked_name(state)}")

    def table(self, spark: SparkSession) -> DataFrame:
        """``value, job, state`` of all notes; the first note must have been made."""
        return spark.read.schema("value string, job string, state string").parquet(self.folder)

    def of(self, spark: SparkSession, job: str) -> dict[str, dict]:
        """The values of a job's notes by state."""
        return {r.state: json.loads(r.value) for r in self.table(spark).where(F.col("job") == job).collect()}

    def jobs(self, spark: SparkSession, state: str, without: str | None = None) -> list[str]:
        """Jobs that reached ``state``, but not ``without``, by name."""
        noted = self.table(spark)
        found = noted.where(F.col("state") == state).select("job")
        if without is not None:
            found = found.join(noted.where(F.col("state") == without).select("job"), "job", "left_anti")
        return sorted(r.job for r in found.collect())


def replace(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` in place of what a folder holds, and read them back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns and types of a declared schema; missing ones are NULL, others are left out."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])
