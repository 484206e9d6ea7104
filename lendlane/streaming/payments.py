"""Payment events as a stream: one outcome per event, each booking paid once.

Every micro-batch is judged by the batch operator against the bookings as the
earlier micro-batches left them, and its outcomes become one partition of a
Parquet log.  So the stream gives what a replay gives, and a booking with very many
events in one batch is spread like there.

* What a booking is bound to never expires: it is kept in ``BookingState``.  An
  event may come however late, so there is no watermark, and a redelivered one is
  a duplicate.
* Of the stored bookings and bound sessions a batch reads the parts it touches, and shuffles neither.
* A batch that is run again after a failure reads only what earlier batches left, and
  overwrites its own partitions: the log holds one outcome per event.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lendlane.functions.columns import js_positive_id
from lendlane.operators.payments import parse_events, payment_event_classify, pending_events
from lendlane.streaming.state import BookingState

def json_event_source(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Event JSON, one document per line, as a stream of flat events in file order."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return parse_events(lines, "value")


@dataclass(frozen=True)
class OutcomeLog:
    """Where outcomes and state are; keep the other values as they are for the life of a log.

    A part of the state is read as a snapshot and fewer than ``snapshot_every`` additions.
    """

    folder: str
    snapshot_every: int = 100
    parts: int = 64
    buckets: int = 16

    @property
    def state(self) -> BookingState:
        return BookingState(f"{self.folder}/state", self.parts, self.buckets, self.snapshot_every)

    def partition(self, batch_id: int) -> str:
        return f"{self.folder}/outcomes/batch={batch_id}"

    def read(self, spark: SparkSession) -> DataFrame:
        """All outcomes written so far, with the number of their batch."""
        return spark.read.parquet(f"{self.folder}/outcomes")


def judge_batch(batch: DataFrame, batch_id: int, bookings: DataFrame | None, log: OutcomeLog) -> None:
    """Classify one micro-batch, write its partition of the log, and store what it bound.

    ``bookings`` is a table of them, else those stored in the log's state are used.
    """
    batch = batch.persist()
    try:
        touched = pending_events(batch).select(F.col("_booking").alias("id")).distinct()
        outcomes = payment_event_classify(batch, log.state.after(touched, batch_id, bookings))
        outcomes.write.mode("overwrite").partitionBy("outcome").parquet(log.partition(batch_id))
        written = batch.sparkSession.read.schema("booking_id string, session_id string, outcome string").parquet(log.partition(batch_id))
        applied = written.where(F.col("outcome") == "applied")
        log.state.bind(applied.select(js_positive_id("booking_id").alias("id"), "session_id"), batch_id)
    finally:
        batch.unpersist()


def start_payment_stream(
    events: DataFrame,
    bookings: Callable[[SparkSession], DataFrame] | None,
    log: OutcomeLog,
    checkpoint: str,
    drain: bool = True,
) -> StreamingQuery:
    """Judge streaming ``events`` into the log.

    ``bookings`` is called for each batch, so that bookings made meanwhile are found; without it the
    bookings stored in the log's state are used, also those added while the query runs.
    One query at a time writes a log.  With ``drain`` the query stops once the input
    there is has been read, else it goes on.
    """
    writer = events.writeStream.foreachBatch(
        lambda batch, batch_id: judge_batch(batch, batch_id, bookings(batch.sparkSession) if bookings else None, log)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()
