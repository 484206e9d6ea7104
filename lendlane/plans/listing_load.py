"""A whole listing load as one job: the host, new listings, their ids, and a default profile for each.

Two tables get rows, and both or none of them count: readers see the loads whose end is in the journal.
Ids are reserved there together with the frozen rows, so a load that died half-way is finished with the
same ids, by its own next run or by the next load.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.operators.listings import (
    IMPORT_KEY, START_KEY, HostRequest, default_profiles, host_resolution, listing_defaults, listing_import,
    number_from, start_listing_defaults,
)
from lendlane.sources.store import Journal, checked_name, conform, replace
from lendlane.sources.tables import TABLE_SCHEMAS

TABLES = ("trailers", "pricing_profiles")


@dataclass(frozen=True)
class LoadKind:
    """What a load sets, by which columns a listing is known already, and which existing ones count.

    ``known_prefix`` limits those to descriptions that begin with it.
    """

    defaults: Callable[[DataFrame, object], DataFrame]
    key: Sequence[str]
    known_prefix: str | None = None


PLACEHOLDERS = LoadKind(listing_defaults, tuple(IMPORT_KEY))


def start_listings(prefix: str) -> LoadKind:
    """A bookable load: known are listings of the name whose description begins with ``prefix``."""
    return LoadKind(start_listing_defaults, tuple(START_KEY), prefix)


@dataclass(frozen=True)
class ListingStore:
    """Stored listings and price profiles, one partition per load."""

    folder: str

    @property
    def journal(self) -> Journal:
        return Journal(f"{self.folder}/journal")

    def partition(self, table: str, load: str) -> str:
        return f"{self.folder}/{table}/load={checked_name(load)}"

    def staged(self, spark: SparkSession, table: str, load: str) -> DataFrame:
        return spark.read.schema(TABLE_SCHEMAS[table]).parquet(self._stage(table, load))

    def _stage(self, table: str, load: str) -> str:
        return f"{self.folder}/staged/{checked_name(load)}/{table}"

    def create(self, trailers: DataFrame, profiles: DataFrame, load: str = "base") -> None:
        """Begin a store with the rows there are; columns that are not in them are NULL."""
        spark, last = trailers.sparkSession, []
        for table, rows in zip(TABLES, (trailers, profiles)):
            written = replace(conform(rows, TABLE_SCHEMAS[table]), self.partition(table, load))
            last.append(written.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        self.journal.note(spark, load, "reserved", last_listing=last[0], last_profile=last[1])
        self.journal.note(spark, load, "done")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Rows of all finished loads, with the load's name; the partitions of others are not read."""
        done = self.journal.table(spark).where(F.col("state") == "done").select(F.col("job").alias("load"))
        rows = spark.read.schema(TABLE_SCHEMAS[table] + ", load string").parquet(f"{self.folder}/{table}")
        return rows.join(F.broadcast(done), "load", "left_semi")  # one short row per load

    def reserve(self, batch: DataFrame, hosts: DataFrame, request: HostRequest, as_of, load: str, kind: LoadKind) -> None:
        """Decide which rows of ``batch`` are new, freeze them with their ids, and note that."""
        spark = batch.sparkSession
        host = host_resolution(hosts, [request]).first()
        if host.error is not None:
            raise LookupError(host.error)
        owned = batch.withColumns({"host_id": F.lit(host.host_id).cast("bigint"), "host_uid": F.lit(host.host_uid)})
        there = self.read(spark, "trailers")
        if kind.known_prefix is not None:
            there = there.where(F.col("description").startswith(kind.known_prefix))
        new = listing_import(owned, there, kind.key)
        notes = self.journal.table(spark).where(F.col("state") == "reserved")
        tops = [F.coalesce(F.max(F.get_json_object("value", f"$.{c}").cast("bigint")), F.lit(0)) for c in ("last_listing", "last_profile")]
        first_listing, first_profile = notes.agg(*tops).first()
        numbered = number_from(kind.defaults(new, as_of), first_listing)
        listed = replace(conform(numbered, TABLE_SCHEMAS["trailers"]), self._stage("trailers", load))
        profiles = default_profiles(listed, first_profile - first_listing, as_of)
        replace(conform(profiles, TABLE_SCHEMAS["pricing_profiles"]), self._stage("pricing_profiles", load))
        n = listed.count()
        self.journal.note(spark, load, "reserved", last_listing=first_listing + n, last_profile=first_profile + n)

    def publish(self, spark: SparkSession, load: str) -> None:
        """Copy the frozen rows into both tables and note the end.  Running it again changes nothing."""
        for table in TABLES:
            replace(self.staged(spark, table, load), self.partition(table, load))
        self.journal.note(spark, load, "done")

    def finish(self, spark: SparkSession) -> list[str]:
        """Finish the loads that died after their reservation."""
        open_loads = self.journal.jobs(spark, "reserved", without="done")
        for load in open_loads:
            self.publish(spark, load)
        return open_loads


def load_listings(
    store: ListingStore, batch: DataFrame, hosts: DataFrame, request: HostRequest, as_of, load: str,
    kind: LoadKind = PLACEHOLDERS,
) -> bool:
    """Load ``batch`` under the name ``load``; false if that name has been loaded already.

    ``batch`` has ``seq``, ``photo`` and columns of listings.  Its listings belong to the host that ``request``
    finds; without one ``LookupError`` lists the hosts.  Rows known already, or repeated in the batch, are left
    out; an empty batch is loaded as such.
    """
    spark = batch.sparkSession
    store.finish(spark)
    if "done" in store.journal.of(spark, load):
        return False
    store.reserve(batch, hosts, request, as_of, load, kind)
    store.publish(spark, load)
    return True
