"""The public availability feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.columns import blur, is_true, lower_or_empty, moment
from lendlane.operators.skew import lookup_join

# Booking states, in lower case, in which a listing is out on rent.
RENTING_STATES = ["paid_confirmed", "in_progress"]

# What the feed shows of a listing and of its prices.
LISTING_COLUMNS = [
    "id", "trailername", "model", "trailer_type", "thumbnail", "photos", "main_category", "subtype",
    "is_available", "delivery_available", "verified", "insurance_status", "description",
    "capacity_kg", "dimensions_m",
]
PROFILE_PRICES = ["short_rental_price", "daily_rate", "weekly_rate", "monthly_rate"]


def status_is_active() -> Column:
    return lower_or_empty("status") == "active"


def busy_flag() -> Column:
    """Shown as taken without being rented; never NULL."""
    return is_true("busy_display") & ~is_true("is_available")


def listing_status_filter(trailers: DataFrame) -> DataFrame:
    return trailers.where(status_is_active())


def coordinate_blur(trailers: DataFrame, exact_when_busy: bool = True) -> DataFrame:
    """Coordinates to two decimals; busy-display listings can stay exact."""
    def shown(c: str) -> Column:
        if not exact_when_busy:
            return blur(c)
        return F.when(is_true("busy_display"), F.col(c).cast("double")).otherwise(blur(c))

    return trailers.withColumns({c: shown(c) for c in ("latitude", "longitude")})


def is_busy_flag(trailers: DataFrame) -> DataFrame:
    return trailers.withColumn("is_busy", busy_flag())


def currency_fallback(profile_currency: str, listing_currency: str) -> Column:
    return F.coalesce(F.col(profile_currency), F.col(listing_currency), F.lit("EUR"))


def join_matching_or_alone(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    right_id: str,
) -> DataFrame:
    """Left outer join of unique left keys to a right side that may repeat a key a lot.

    A plain left outer join cannot be split on its right side: one hot key there
    would run in one task.  So the right rows look up their left row, spread where
    a key is hot, and the left rows without a match are added.
    """
    keyed = left.withColumn(right_key, F.col(left_key))
    matched = lookup_join(right, keyed, [right_key], [right_id], "inner")
    known = right.select(F.col(right_key).alias("_known")).distinct()
    alone = keyed.join(known, F.col(left_key) == F.col("_known"), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def listing_price_left_join(
    trailers: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Listings with each of their active profiles; listings without one are kept.

    Here NULL counts as not active.  A listing with two active profiles comes
    twice.
    """
    active = profiles.where(F.col("is_active")).select(
        F.col("trailer_id").alias("pp_trailer_id"),
        F.col("id").alias("pp_id"),
        F.col("currency").alias("pp_currency"),
        *[F.col(c).alias(f"pp_{c}") for c in PROFILE_PRICES],
    )
    return join_matching_or_alone(trailers, active, "id", "pp_trailer_id", "pp_id")


def currently_rented(bookings: DataFrame, as_of) -> DataFrame:
    """Listings out on rent at ``as_of``: one row each.

    The window is half-open.  Bookings are cut down to those running at ``as_of``
    at the scan; the distinct combines before its shuffle.
    """
    now = moment(as_of)
    running = bookings.where(
        (F.col("start_at") <= now) & (F.col("end_at") > now) & lower_or_empty("status").isin(RENTING_STATES)
    )
    return running.where(F.col("trailer_id").isNotNull()).select("trailer_id").distinct()


def _feed(trailers, profiles, bookings, as_of, show_busy: bool, exact_when_busy: bool) -> DataFrame:
    # listings and rented ids are both unique per listing: no hot key in this join
    rented = currently_rented(bookings, as_of).select(F.col("trailer_id").alias("_rented_id"))
    listed = listing_status_filter(trailers)
    free = is_true("is_available")
    if show_busy:
        listed = (
            listed.where(free | busy_flag())
            .join(rented, F.col("id") == F.col("_rented_id"), "left")
            .where(busy_flag() | F.col("_rented_id").isNull())
            .drop("_rented_id")
        )
    else:
        listed = listed.where(free).join(rented, F.col("id") == F.col("_rented_id"), "left_anti")
    if show_busy:
        listed = is_busy_flag(listed)
    listed = coordinate_blur(listed, exact_when_busy)
    priced = listing_price_left_join(listed, profiles)
    return priced.select(
        *[c for c in LISTING_COLUMNS if c in trailers.columns],
        "latitude",
        "longitude",
        currency_fallback("pp_currency", "currency").alias("currency"),
        *[F.col(f"pp_{c}").alias(c) for c in PROFILE_PRICES],
        "price_per_hr",
        *(["is_busy"] if show_busy else []),
    )


def public_feed_available(
    trailers: DataFrame, profiles: DataFrame, bookings: DataFrame, as_of
) -> DataFrame:
    """First feed: active, available listings that are not out on rent."""
    return _feed(trailers, profiles, bookings, as_of, show_busy=False, exact_when_busy=False)


def public_feed_busy(
    trailers: DataFrame, profiles: DataFrame, bookings: DataFrame, as_of
) -> DataFrame:
    """Second feed: the first one plus busy-display listings, all blurred."""
    return _feed(trailers, profiles, bookings, as_of, show_busy=True, exact_when_busy=False)


def public_feed_current(
    trailers: DataFrame, profiles: DataFrame, bookings: DataFrame, as_of
) -> DataFrame:
    """Current feed: the second one with exact coordinates for busy-display listings."""
    return _feed(trailers, profiles, bookings, as_of, show_busy=True, exact_when_busy=True)


def busy_share(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count_if("is_busy").alias("busy"), F.count(F.lit(1)).alias("total"))


def effective_price_list(
    trailers: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Every listing with its profiles in force; here NULL counts as active."""
    active = profiles.where(F.coalesce(F.col("is_active"), F.lit(True))).select(
        F.col("trailer_id").alias("pp_trailer_id"),
        F.col("id").alias("profile_id"),
        F.col("name").alias("profile_name"),
        *PROFILE_PRICES,
    )
    listed = trailers.select("id", "trailername", "price_per_hr")
    joined = join_matching_or_alone(listed, active, "id", "pp_trailer_id", "profile_id")
    # the profile id lets the range sort split a listing with very many profiles
    return joined.drop("pp_trailer_id").orderBy("id", F.col("profile_id").asc_nulls_last())


def seed_profile_report(trailers: DataFrame, profiles: DataFrame, prefix: str) -> DataFrame:
    """Listings whose description starts with ``prefix``, with their profiles in force."""
    seeds = trailers.where(F.col("description").startswith(prefix)).select(
        "id", "trailername", "main_category", "location_name", "price_per_hr"
    )
    active = profiles.where(F.coalesce(F.col("is_active"), F.lit(True))).select(
        F.col("trailer_id").alias("pp_trailer_id"), F.col("id").alias("profile_id"), *PROFILE_PRICES
    )
    return (
        active.join(seeds, F.col("id") == F.col("pp_trailer_id"), "inner")
        .select("id", "trailername", "main_category", "location_name", "price_per_hr", "profile_id", *PROFILE_PRICES)
        .orderBy("id", "profile_id")
    )


def photo_count(feed: DataFrame) -> DataFrame:
    """Pictures per row, most first.  ``photos`` may be a map, an array or JSON text."""
    kind = feed.schema["photos"].dataType.typeName()
    if kind == "string":
        count = F.coalesce(
            F.json_array_length("photos"), F.size(F.json_object_keys("photos")).cast("int")
        )
    else:
        count = F.when(F.col("photos").isNotNull(), F.size("photos"))
    return feed.select("id", "trailername", count.cast("bigint").alias("pictures")).orderBy(
        F.col("pictures").desc_nulls_last(), "id"
    )


def map_link(trailers: DataFrame, base: str = "https://maps.google.com/?q=") -> DataFrame:
    """Clickable position; NULL where a coordinate is missing."""
    link = F.concat(F.lit(base), F.col("latitude").cast("string"), F.lit(","), F.col("longitude").cast("string"))
    return trailers.select("id", "location_name", "trailername", link.alias("map_link")).orderBy(
        F.col("location_name").asc_nulls_last(), "id"
    )
