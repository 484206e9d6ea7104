"""The one-active rule between loads: a small state per listing, stored, to which every load is added.

The state says all that ``one_active_fold`` needs of the profiles so far.  States merge in any order, and a load added
twice changes nothing, so profiles may come in any batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lendlane.operators.pricing import active_flags, active_state, merge_active_states
from lendlane.plans.stored_upsert import StoredTable

STATE = "trailer_id bigint, last_priced bigint, first_active bigint, first_flag boolean"


@dataclass(frozen=True)
class ActiveProfiles:
    """Keep ``buckets`` as it is for the life of a folder."""

    folder: str
    buckets: int = 64

    @property
    def stored(self) -> StoredTable:
        return StoredTable(self.folder, STATE, "trailer_id", self.buckets)

    def create(self, spark: SparkSession) -> None:
        self.stored.create(spark.createDataFrame([], STATE))

    def add(self, profiles: DataFrame, load: str) -> bool:
        """Add a load's profiles; only buckets with its listings are read and written.  False if it was added before."""
        state = active_state(profiles)
        return self.stored.rewrite(state, load, lambda old: merge_active_states(old, state))

    def state(self, spark: SparkSession) -> DataFrame:
        return self.stored.read(spark)

    def flags(self, profiles: DataFrame) -> DataFrame:
        """``profiles``, of any loads added so far, as the rule leaves them."""
        return active_flags(profiles, self.state(profiles.sparkSession))
