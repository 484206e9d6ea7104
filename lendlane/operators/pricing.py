"""Price profiles: floors, one active profile per listing, price reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.columns import epoch_micros, moment, not_false, positive, touch
from lendlane.operators.skew import (
    attach_aggregates, id_order, lookup_join, newest_first, rank_rows,
)

# Lowest price in euro per rate, and the rates that count as "priced".
PRICE_FLOORS = {
    "short_rental_price": 5,
    "hourly_rate": 5,
    "daily_rate": 12,
    "weekly_rate": 60,
    "monthly_rate": 180,
}
# Rates that make a profile complete, and that the audit looks at.
COMPLETE_RATES = ["short_rental_price", "daily_rate", "weekly_rate", "monthly_rate"]


def _rates(df: DataFrame) -> list[str]:
    return [c for c in PRICE_FLOORS if c in df.columns]


def _euro() -> Column:
    return F.lower(F.coalesce(F.col("currency"), F.lit("eur"))) == "eur"


def _below(rate: str) -> Column:
    """Above zero and below the floor; never NULL."""
    return positive(rate) & (F.coalesce(F.col(rate), F.lit(0)) < PRICE_FLOORS[rate])


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def price_floor(profiles: DataFrame, as_of=None) -> DataFrame:
    """Raise euro prices of listing profiles to the floor; zero and NULL stay.

    Given ``as_of``, rows that changed get it as ``updated_at``; without it
    only prices move, as when a row passes the insert rule.
    """
    in_scope = F.col("trailer_id").isNotNull() & _euro()
    raised = {
        r: F.when(in_scope & _below(r), F.lit(PRICE_FLOORS[r])).otherwise(F.col(r)).cast(profiles.schema[r].dataType)
        for r in _rates(profiles)
    }
    if as_of is not None:
        raised["updated_at"] = touch(profiles, in_scope & _any([_below(r) for r in _rates(profiles)]), as_of)
    return profiles.withColumns(raised)


def subfloor_audit(profiles: DataFrame) -> DataFrame:
    """Active euro profiles with a price under its floor.  The hourly rate is not looked at."""
    checked = [r for r in COMPLETE_RATES if r in profiles.columns]
    return profiles.where(
        F.col("trailer_id").isNotNull() & not_false("is_active") & _euro() & _any([_below(r) for r in checked])
    ).select("id", "trailer_id", "name", *checked)


def _complete() -> Column:
    result = F.lit(True)
    for r in COMPLETE_RATES:
        result = result & positive(r)
    return result


def _quality() -> Column:
    """0 is best: complete first, then a NULL name, then 'Default', then the rest."""
    by_name = F.when(F.col("name").isNull(), 0).when(F.col("name") == "Default", 1).otherwise(2)
    return F.when(_complete(), 0).otherwise(3) + by_name


def _candidates(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("trailer_id").isNotNull() & not_false("is_active"))


def profile_rank(profiles: DataFrame) -> DataFrame:
    """Rank of every active profile within its listing; 1 is the one to keep."""
    order = [_quality().cast("bigint"), newest_first(epoch_micros(profiles, "updated_at")), id_order("id", descending=True)]
    ranked = rank_rows(_candidates(profiles), ["trailer_id"], order, "rn")
    return ranked.select("id", "trailer_id", "rn")


def _goodness() -> Column:
    """The ranking turned round: the best row has the largest value.  NULL is smallest."""
    return F.struct((-_quality()).alias("q"), F.col("updated_at").alias("u"), F.col("id").alias("i"))


def best_profiles(profiles: DataFrame) -> DataFrame:
    """The one profile in force per listing, chosen by the ranking of ``profile_rank``.  Combines map-side."""
    best = F.max_by(F.struct("id", "short_rental_price"), _goodness())
    return (
        _candidates(profiles).groupBy(F.col("trailer_id").alias("best_trailer_id")).agg(best.alias("b"))
        .select("best_trailer_id", F.col("b.id").alias("best_id"), F.col("b.short_rental_price").alias("best_price"))
    )


def deactivate_duplicates(profiles: DataFrame, as_of) -> DataFrame:
    """Switch off every active profile that is not its listing's best."""
    # graded before it is aggregated: tasks sort grades, not the columns these are made of
    graded = profiles.withColumn("_good", F.when(not_false("is_active"), _goodness()))
    joined = attach_aggregates(graded, ["trailer_id"], [F.max("_good").getField("i").alias("_best")], ["id"])
    loser = F.col("trailer_id").isNotNull() & not_false("is_active") & (F.col("id") != F.col("_best"))
    return (
        joined.withColumn("_loser", F.coalesce(loser, F.lit(False)))
        .withColumns({
            "is_active": F.when(F.col("_loser"), F.lit(False)).otherwise(F.col("is_active")),
            "updated_at": touch(profiles, F.col("_loser"), as_of),
        })
        .select(*profiles.columns)
    )


def one_active_fold(profiles: DataFrame, as_of=None) -> DataFrame:
    """State after inserting the profiles one by one, by id, under the one-active rule.

    A priced profile switches every earlier one off.  An unpriced profile comes
    in switched off if an active one is there, else it keeps its own flag.  So:

    * with any priced profile, the last priced one is active and no other;
    * without, the first that counts as active keeps its flag (maybe NULL);
      later ones are off; earlier ones were off already.

    Rows without a listing are left alone.  Given ``as_of``, a profile that a later
    one switched off gets it as ``updated_at``.
    """
    priced = _any([positive(r) for r in _rates(profiles)])
    flagged = profiles.withColumn("_priced", priced)
    joined = attach_aggregates(
        flagged,
        ["trailer_id"],
        [
            F.max(F.when(F.col("_priced"), F.col("id"))).alias("_last_priced"),
            F.min(F.when(F.col("_priced"), F.col("id"))).alias("_first_priced"),
            F.min(F.when(not_false("is_active"), F.col("id"))).alias("_first_active"),
        ],
        ["id"],
    )
    active = (
        F.when(F.col("trailer_id").isNull(), F.col("is_active"))
        .when(F.col("_last_priced").isNotNull(), F.col("id") == F.col("_last_priced"))
        .when(F.col("id") > F.col("_first_active"), F.lit(False))
        .otherwise(F.col("is_active"))
    )
    columns = {"is_active": active}
    if as_of is not None:
        # active when inserted, then switched off by a later priced profile
        stood = F.col("_priced") | (F.col("id") == F.least("_first_active", "_first_priced"))
        off = F.col("trailer_id").isNotNull() & stood & (F.col("id") < F.col("_last_priced"))
        columns["updated_at"] = touch(profiles, F.coalesce(off, F.lit(False)), as_of)
    return joined.withColumns(columns).select(*profiles.columns)


def active_state(profiles: DataFrame) -> DataFrame:
    """What the one-active rule must know of some profiles, per listing.

    ``last_priced``, the id of the last priced profile; ``first_active``, that of the first one inserted as
    active, and its flag ``first_flag`` (true or NULL).  Combines map-side.
    """
    active = F.when(not_false("is_active"), F.col("id"))
    priced = F.when(_any([positive(r) for r in _rates(profiles)]), F.col("id"))
    return profiles.where(F.col("trailer_id").isNotNull()).groupBy("trailer_id").agg(
        F.max(priced).alias("last_priced"), F.min(active).alias("first_active"), F.min_by("is_active", active).alias("first_flag"))


def merge_active_states(*states: DataFrame) -> DataFrame:
    """The state of all profiles from states of parts; parts may overlap and come in any order."""
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    return rows.groupBy("trailer_id").agg(
        F.max("last_priced").alias("last_priced"), F.min("first_active").alias("first_active"),
        F.min_by("first_flag", "first_active").alias("first_flag"))


def active_flags(profiles: DataFrame, state: DataFrame) -> DataFrame:
    """``profiles`` as inserted, with ``is_active`` as the one-active rule leaves it once all of ``state`` is in."""
    joined = lookup_join(profiles, state, ["trailer_id"], ["id"])
    active = (
        F.when(F.col("last_priced").isNotNull(), F.col("id") == F.col("last_priced"))
        .when(F.col("id") > F.col("first_active"), F.lit(False))
        .otherwise(F.col("is_active"))
    )
    return joined.withColumn("is_active", active).select(*profiles.columns)


def orphan_profiles(trailers: DataFrame, profiles: DataFrame, as_of) -> DataFrame:
    """A default profile for each hosted listing that has none at all."""
    price = F.coalesce(F.col("price_per_hr"), F.lit(0)).cast("decimal(10,2)")
    zero = F.lit(0).cast("decimal(10,2)")
    known = profiles.select(F.col("trailer_id").alias("id")).distinct()  # combines map-side: no hot key
    return (
        trailers.where(F.col("host_id").isNotNull())
        .select("id", "host_id", "currency", "price_per_hr")
        .join(known, "id", "left_anti")
        .select(
            F.col("id").alias("trailer_id"),
            "host_id",
            F.lit("Default").alias("name"),
            F.lit(True).alias("is_active"),
            F.coalesce("currency", F.lit("EUR")).alias("currency"),
            price.alias("hourly_rate"),
            price.alias("short_rental_price"),
            zero.alias("daily_rate"),
            zero.alias("weekly_rate"),
            zero.alias("monthly_rate"),
            moment(as_of).alias("created_at"),
            moment(as_of).alias("updated_at"),
        )
    )


def price_sync(trailers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Listing price := short price of its profile in force, where that is above zero.

    With several active profiles the best-ranked one is used.
    """
    candidates = profiles.where(positive("short_rental_price"))
    joined = trailers.join(best_profiles(candidates), F.col("id") == F.col("best_trailer_id"), "left")
    kind = trailers.schema["price_per_hr"].dataType
    return joined.withColumn("price_per_hr", F.coalesce(F.col("best_price").cast(kind), F.col("price_per_hr"))).select(
        *trailers.columns
    )


def double_active_audit(profiles: DataFrame) -> DataFrame:
    """Listings with more than one active profile, and how many."""
    return (
        _candidates(profiles).groupBy("trailer_id").agg(F.count(F.lit(1)).alias("active_profiles"))
        .where(F.col("active_profiles") > 1)
    )
