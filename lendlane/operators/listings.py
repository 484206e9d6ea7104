"""Listing loads, placeholder repairs and per-city reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.columns import moment
from lendlane.operators.skew import id_order, rank_rows

IMPORT_KEY = ["host_id", "trailername", "location_name", "model"]
START_KEY = ["host_id", "trailername"]

# The constants of a placeholder load and of a bookable start load.
PLACEHOLDER_DEFAULTS = {
    "price_per_hr": (5, "decimal(10,2)"),
    "currency": ("EUR", "string"),
    "requires_approval": (True, "boolean"),
    "has_insurance": (False, "boolean"),
    "status": ("active", "string"),
    "is_available": (False, "boolean"),
    "busy_display": (True, "boolean"),
    "verified": (True, "boolean"),
}
PLACEHOLDER_DAYS = 180
DEFAULT_PROFILE = {
    "short_rental_price": 5,
    "hourly_rate": 5,
    "daily_rate": 12,
    "weekly_rate": 60,
    "monthly_rate": 180,
}


def _first_of_batch(batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row per key by ``order``.  Combines map-side: a hot key is one row per task."""
    rest = [c for c in batch.columns if c not in key and c != order]
    first = [F.min(F.col(order)).alias(order)]
    if rest:
        first.append(F.min_by(F.struct(*rest), F.col(order)).alias("_rest"))
    return batch.groupBy(*key).agg(*first).select(
        *[F.col(f"_rest.{c}") if c in rest else F.col(c) for c in batch.columns]
    )


def listing_import(
    batch: DataFrame, existing: DataFrame, key: Sequence[str] = tuple(IMPORT_KEY), order: str = "seq"
) -> DataFrame:
    """Rows of ``batch`` to insert: first of their key, and the key not there yet.

    SQL equality never holds for NULL, so a row with a NULL in its key is a
    duplicate of nothing and always goes in.
    """
    key = list(key)
    some_null = F.lit(False)
    for k in key:
        some_null = some_null | F.col(k).isNull()
    known = existing.select(*key).distinct()
    fresh = _first_of_batch(batch.where(~some_null), key, order).join(known, key, "left_anti")
    return fresh.select(*batch.columns).unionByName(batch.where(some_null))


def listing_import_start(
    batch: DataFrame, existing: DataFrame, prefix: str, key: Sequence[str] = tuple(START_KEY), order: str = "seq"
) -> DataFrame:
    """As ``listing_import``, but only existing rows whose description starts with ``prefix`` count."""
    return listing_import(batch, existing.where(F.col("description").startswith(prefix)), key, order)


def listing_defaults(batch: DataFrame, as_of, photo: str = "photo") -> DataFrame:
    """The constants of a placeholder load."""
    now = moment(as_of)
    return batch.withColumns({
        **{c: F.lit(v).cast(t) for c, (v, t) in PLACEHOLDER_DEFAULTS.items()},
        "thumbnail": F.col(photo),
        "photos": F.create_map(F.lit("mainView"), F.col(photo)),
        "starter_expires_at": now + F.make_dt_interval(F.lit(PLACEHOLDER_DAYS)),
        "created_at": now,
        "updated_at": now,
    })


def start_listing_defaults(batch: DataFrame, as_of, photo: str = "photo") -> DataFrame:
    """The constants of a bookable start load: available, no expiry."""
    return listing_defaults(batch, as_of, photo).withColumn("is_available", F.lit(True)).drop(
        "busy_display", "starter_expires_at"
    )


def assign_ids(new_rows: DataFrame, existing: DataFrame, order: str = "seq", name: str = "id") -> DataFrame:
    """Ids after the largest existing one, in source order.

    The numbering counts rows range by range, so it neither pulls the load
    into one task nor depends on how it is partitioned.
    """
    top = existing.agg(F.coalesce(F.max(name), F.lit(0)).cast("bigint").alias("top")).scalar()
    numbered = rank_rows(new_rows, [], [id_order(order)], "_position")
    return numbered.withColumn(name, top + F.col("_position")).drop("_position")


def number_from(new_rows: DataFrame, top: int, order: str = "seq", name: str = "id") -> DataFrame:
    """Ids after ``top``, in source order."""
    numbered = rank_rows(new_rows, [], [id_order(order)], "_position")
    return numbered.withColumn(name, F.lit(top).cast("bigint") + F.col("_position")).drop("_position")


def default_profiles(listings: DataFrame, shift: int | Column, as_of) -> DataFrame:
    """One default profile per listing; its id is the listing's plus ``shift``, so both follow one order."""
    now = moment(as_of)
    return listings.select(
        (F.col("id") + shift).alias("id"),
        F.col("id").alias("trailer_id"),
        "host_id",
        F.lit("Default").alias("name"),
        F.lit("EUR").alias("currency"),
        F.lit(True).alias("is_active"),
        *[F.lit(v).cast("decimal(10,2)").alias(c) for c, v in DEFAULT_PROFILE.items()],
        F.lit(1).alias("min_hours"),
        F.lit(1).alias("min_days"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def default_profile_for_import(
    new_listings: DataFrame, trailers: DataFrame, profiles: DataFrame, as_of, order: str = "seq"
) -> DataFrame:
    """One default profile per new listing, with the listing's new id."""
    with_listing = assign_ids(new_listings.select(order, "host_id"), trailers, order)
    first_profile = profiles.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top")).scalar()
    first_listing = trailers.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top")).scalar()
    return default_profiles(with_listing, first_profile - first_listing, as_of)


@dataclass(frozen=True)
class HostRequest:
    """Whom a load should belong to: exact e-mails first, else a fragment of e-mail or name."""

    name: str
    emails: tuple[str, ...]
    fragment: str


# How a host is written in lists, short and with the name.
HOST_FIELDS = {"id": "id", "email": "email"}
NAMED_HOST_FIELDS = {"id": "id", "email": "email", "nimi": "full_name"}


def _host_entry(fields: dict[str, str]) -> Column:
    """``'id=… email=…'``: a label and a value for each field, a dash for NULL."""
    pattern = " ".join(f"{label}=%s" for label in fields)
    return F.format_string(pattern, *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields.values()])


def host_resolution(hosts: DataFrame, requests: Sequence[HostRequest], listed: int = 50) -> DataFrame:
    """One row per request: the chosen host and the tier that found it.

    Tier 1 is an exact e-mail, tier 2 the fragment in e-mail or name, tier 3 the
    only host there is; within a tier the lowest id.  Without any, ``error`` says so and lists
    the hosts there are, the ``listed`` lowest ids by name and the rest as a number: ``host_list_agg`` gives all.
    All requests are answered in one aggregate over the hosts.
    """
    row = F.struct(F.col("id").alias("id"), F.col("host_uid").alias("host_uid"))
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    best = []
    for n, r in enumerate(requests):
        found = F.lower(F.coalesce("email", F.lit(""))).contains(r.fragment) | F.lower(
            F.coalesce("full_name", F.lit(""))
        ).contains(r.fragment)
        tier = F.when(email.isin(list(r.emails)), 1).when(found, 2)
        best.append(F.min(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), row.alias("host")))).alias(f"r{n}"))
    summary = hosts.agg(*best, F.count(F.lit(1)).alias("n"), F.min(row).alias("only"))
    only = F.when(F.col("n") == 1, F.struct(F.lit(3).alias("tier"), F.col("only").alias("host")))
    answers = [
        F.struct(F.lit(r.name).alias("request"), F.coalesce(F.col(f"r{n}"), only).alias("pick"))
        for n, r in enumerate(requests)
    ]
    lowest = hosts.select("id", _host_entry(NAMED_HOST_FIELDS).alias("entry")).orderBy("id").limit(listed)
    names = lowest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda x: x["entry"]), "; ")).scalar()
    more = F.when(F.col("n") > listed, F.concat(F.lit("; and "), (F.col("n") - listed).cast("string"), F.lit(" more"))).otherwise("")
    return summary.select("n", F.explode(F.array(*answers)).alias("a")).select(
        "a.request",
        F.col("a.pick.tier").alias("tier"),
        F.col("a.pick.host.id").alias("host_id"),
        F.col("a.pick.host.host_uid").alias("host_uid"),
        F.when(F.col("a.pick").isNull(), F.concat(F.lit("host not found"), F.when(F.col("n") > 0, F.concat(F.lit(": "), names, more)).otherwise(""))).alias("error"),
    )


def host_list_agg(hosts: DataFrame, per_line: int = 1000, fields: dict[str, str] = HOST_FIELDS) -> DataFrame:
    """All hosts as text, ``'id=… email=…'`` joined by ``'; '``, by id; ``fields`` gives labels and columns.

    The text is cut into lines of ``per_line`` consecutive ids, as a single string
    would hold the whole table; joining the lines in order gives it.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("id"), _host_entry(fields).alias("entry"))))
    return (
        hosts.groupBy(F.floor(F.col("id").cast("decimal(20,0)") / F.lit(per_line)).cast("bigint").alias("line"))
        .agg(F.array_join(F.transform(ordered, lambda x: x["entry"]), "; ").alias("host_list"))
        .orderBy("line")
    )


def slot_in_city(
    trailers: DataFrame, slots: int = 6, model: str | None = None
) -> DataFrame:
    """Slot of each listing in its city: position by id, modulo ``slots``."""
    chosen = trailers if model is None else trailers.where(F.col("model") == model)
    ranked = rank_rows(chosen.select("id", "location_name"), ["location_name"], [id_order("id")], "_position")
    return ranked.select("id", "location_name", F.pmod(F.col("_position") - 1, F.lit(slots)).cast("bigint").alias("slot"))


def relocate_listings(
    trailers: DataFrame,
    centres: DataFrame,
    offsets: DataFrame,
    as_of,
    model: str | None = None,
) -> DataFrame:
    """Move listings of known cities to the city centre plus their slot's offset.

    Only the moves are joined back to the listings, by their unique id; listings of
    other cities stay as they are.
    """
    slots = slot_in_city(trailers, 6, model)
    moves = (
        slots.join(centres, F.col("location_name") == F.col("loc"))
        .join(offsets, F.col("slot") == F.col("i"))
        .select(
            F.col("id").alias("_id"),
            (F.col("clat") + F.col("dlat")).alias("_lat"),
            (F.col("clng") + F.col("dlng")).alias("_lng"),
        )
    )
    hit = F.col("_id").isNotNull()
    new = {
        c: F.when(hit, F.col(v).cast(trailers.schema[c].dataType)).otherwise(F.col(c))
        for c, v in (("latitude", "_lat"), ("longitude", "_lng"))
    }
    joined = trailers.join(moves, F.col("id") == F.col("_id"), "left")
    moved = joined.withColumns({**new, "updated_at": F.when(hit, moment(as_of, trailers)).otherwise(
        F.col("updated_at") if "updated_at" in trailers.columns else F.lit(None)
    )})
    return moved.select(*trailers.columns, *([] if "updated_at" in trailers.columns else ["updated_at"]))


def like_any_district(trailers: DataFrame, cities: Sequence[str]) -> DataFrame:
    """Listings whose location is ``'<district>, <city>'`` for one of ``cities``."""
    ends = F.exists(F.array(*[F.lit(f", {c}") for c in cities]), lambda tail: F.endswith(F.col("location_name"), tail))
    return trailers.where(ends)


def expired_listings(trailers: DataFrame, as_of, model: str | None = None) -> DataFrame:
    """Placeholder listings past their expiry."""
    expired = F.col("starter_expires_at") < moment(as_of)
    return trailers.where(expired if model is None else expired & (F.col("model") == model))


def expired_profiles(trailers: DataFrame, profiles: DataFrame, as_of, model: str | None = None) -> DataFrame:
    """Price profiles of the listings past their expiry."""
    gone = expired_listings(trailers, as_of, model).select(F.col("id").alias("trailer_id"))
    return profiles.join(gone, "trailer_id", "left_semi").select(*profiles.columns)


def without_expired(trailers: DataFrame, as_of, model: str | None = None) -> DataFrame:
    """Listings that stay: an unknown expiry is kept."""
    expired = F.col("starter_expires_at") < moment(as_of)
    if model is not None:
        expired = expired & (F.col("model") == model)
    return trailers.where(~F.coalesce(expired, F.lit(False)))


def profiles_without_expired(trailers: DataFrame, profiles: DataFrame, as_of, model: str | None = None) -> DataFrame:
    gone = expired_listings(trailers, as_of, model).select(F.col("id").alias("trailer_id"))
    return profiles.join(gone, "trailer_id", "left_anti").select(*profiles.columns)


def listings_per_city(trailers: DataFrame, model: str | None = None) -> DataFrame:
    chosen = trailers if model is None else trailers.where(F.col("model") == model)
    return (
        chosen.groupBy("location_name").agg(F.count(F.lit(1)).alias("listings"))
        .orderBy(F.col("location_name").asc_nulls_last())
    )


def listings_per_split_city(trailers: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Listings per city part of ``'<district>, <city>'``; empty text where there is none."""
    chosen = trailers if cities is None else like_any_district(trailers, cities)
    city: Column = F.split_part(F.col("location_name"), F.lit(", "), F.lit(2))
    return (
        chosen.groupBy(city.alias("city")).agg(F.count(F.lit(1)).alias("listings"))
        .orderBy(F.col("city").asc_nulls_last())
    )


def expiry_months(trailers: DataFrame, since) -> DataFrame:
    """The months, as ``yyyy-MM``, in which placeholder listings expire from ``since`` on; repeats are kept."""
    expiring = trailers.where(F.col("starter_expires_at") >= moment(since, trailers, "starter_expires_at"))
    return expiring.select(F.date_format("starter_expires_at", "yyyy-MM").alias("start_month"))
