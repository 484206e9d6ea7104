"""The payout run as one job that may be repeated: plan, transfer results, settled bookings, ledger.

The plan of a run is written before anything is transferred, under the run's name: the outbox.  Results name
the run they answer, and count only for transfers that its plan holds.  Ledger rows and settled bookings go to
the run's own partitions, which a repetition overwrites, so it adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.operators.payouts import payout_due, payout_ledger_append, payout_plan, payout_settle
from lendlane.sources.store import Journal, checked_name, conform, replace
from lendlane.sources.tables import TABLE_SCHEMAS

PLAN_SCHEMA = """booking_id bigint, host_uid string, outcome string, amount_cents bigint, transfer_currency string,
    destination string, blocked_country string"""
SETTLED_SCHEMA = "booking_id bigint, payout_status string, payout_transfer_id string"


@dataclass(frozen=True)
class PayoutStore:
    """Outbox, settled payouts and ledger, one partition per run."""

    folder: str

    @property
    def journal(self) -> Journal:
        return Journal(f"{self.folder}/journal")

    def partition(self, table: str, run: str) -> str:
        return f"{self.folder}/{table}/run={checked_name(run)}"

    def create(self, spark: SparkSession) -> None:
        """Begin an empty store."""
        for table, schema in (("outbox", PLAN_SCHEMA), ("settled", SETTLED_SCHEMA), ("ledger", TABLE_SCHEMAS["host_payouts"])):
            replace(spark.createDataFrame([], schema), self.partition(table, "none"))
        self.journal.note(spark, "none", "settled", place=0)

    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, run string").parquet(f"{self.folder}/{table}")

    def outbox(self, spark: SparkSession) -> DataFrame:
        """Plans of all runs that were noted as planned, with the run."""
        noted = self.journal.table(spark).where(F.col("state") == "planned").select(F.col("job").alias("run"))
        return self._read(spark, "outbox", PLAN_SCHEMA).join(F.broadcast(noted), "run", "left_semi")  # one short row per run

    def settled(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "settled", SETTLED_SCHEMA)

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "ledger", TABLE_SCHEMAS["host_payouts"])

    def bookings(self, bookings: DataFrame) -> DataFrame:
        """Bookings with the payout state their runs left: the last one that settled it stands; open runs are the latest."""
        spark = bookings.sparkSession
        place = self.journal.table(spark).where(F.col("state") == "settled").select(
            F.col("job").alias("run"), F.get_json_object("value", "$.place").cast("bigint").alias("place"))
        ordered = self.settled(spark).join(F.broadcast(place), "run", "left").withColumn("place", F.coalesce("place", F.lit(2**62)))
        last = ordered.groupBy(F.col("booking_id").alias("_booking")).agg(
            F.max_by(F.struct("payout_status", "payout_transfer_id"), F.struct("place", "run")).alias("_p"))
        hit = F.col("_booking").isNotNull()
        transfer = F.col("payout_transfer_id") if "payout_transfer_id" in bookings.columns else F.lit(None).cast("string")
        return bookings.join(last, F.col("id") == F.col("_booking"), "left").withColumns({
            "payout_status": F.when(hit, F.col("_p.payout_status")).otherwise(F.col("payout_status")),
            "payout_transfer_id": F.when(hit, F.col("_p.payout_transfer_id")).otherwise(transfer),
        }).drop("_booking", "_p")

    def plan(self, run: str, bookings: DataFrame, hosts: DataFrame, config: DataFrame, as_of) -> DataFrame:
        """What the run does with each due booking; decided once, and read back by a repetition.

        Bookings in the open outbox of another run, whose transfer may be on its way, are left out.
        """
        spark, notes = bookings.sparkSession, self.journal.of(bookings.sparkSession, run)
        if "planned" not in notes:
            open_runs = [r for r in self.journal.jobs(spark, "planned", without="settled") if r != run]
            away = self.outbox(spark).where(F.col("run").isin(open_runs) & (F.col("outcome") == "transfer")).select(F.col("booking_id").alias("id"))
            due = payout_due(self.bookings(bookings), as_of).join(away, "id", "left_anti")
            replace(conform(payout_plan(due, hosts, config), PLAN_SCHEMA), self.partition("outbox", run))
            self.journal.note(spark, run, "planned")
        return spark.read.schema(PLAN_SCHEMA).parquet(self.partition("outbox", run))

    def settle(self, run: str, bookings: DataFrame, results: DataFrame, as_of) -> DataFrame:
        """Settle a planned run by its ``results`` (``run, booking_id, ok, transfer_id``); the run's ledger rows.

        Transfers without a result stay pending and stay out of other runs until the run is settled again with one;
        a booking in another run's ledger gets no second row.  Results of other runs, or for what was not planned as
        a transfer, count nothing.
        """
        spark = bookings.sparkSession
        if "planned" not in self.journal.of(spark, run):
            raise LookupError(f"run {run} has no plan")
        transfers = spark.read.schema(PLAN_SCHEMA).parquet(self.partition("outbox", run)).where(F.col("outcome") == "transfer")
        answered = results.where(F.col("run") == run).join(transfers.select("booking_id"), "booking_id", "left_semi").select("booking_id", "ok", "transfer_id")
        asked = bookings.join(transfers.select(F.col("booking_id").alias("id")), "id", "left_semi")
        earlier = self.ledger(spark).where(F.col("run") != run)
        rows = replace(conform(payout_ledger_append(asked, answered, earlier, as_of), TABLE_SCHEMAS["host_payouts"]), self.partition("ledger", run))
        hit = asked.join(answered.select(F.col("booking_id").alias("id")), "id", "left_semi").select("id", "payout_status", F.lit(None).cast("string").alias("payout_transfer_id"))
        settled = payout_settle(hit, answered).withColumnRenamed("id", "booking_id")
        replace(conform(settled, SETTLED_SCHEMA), self.partition("settled", run))
        if transfers.join(answered, "booking_id", "left_anti").isEmpty():
            notes = self.journal.table(spark).where(F.col("state") == "settled")
            others = notes.where(F.col("job") != run).agg(F.max(F.get_json_object("value", "$.place").cast("bigint"))).first()[0]
            if "settled" not in self.journal.of(spark, run):
                self.journal.note(spark, run, "settled", place=others + 1)
        return rows


def payout_run(
    store: PayoutStore, run: str, bookings: DataFrame, hosts: DataFrame, config: DataFrame, transfer, as_of,
) -> DataFrame:
    """Plan, transfer and settle; ledger rows of the run.  ``transfer`` gives results for planned transfers.

    ``transfer`` gets the plan's transfers and must itself be repeatable: the provider takes the run and
    booking as idempotency key.
    """
    plan = store.plan(run, bookings, hosts, config, as_of)
    results = transfer(plan.where(F.col("outcome") == "transfer")).withColumn("run", F.lit(run))
    return store.settle(run, bookings, results, as_of)
