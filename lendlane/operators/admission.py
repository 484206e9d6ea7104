"""Booking admission and payment request checks, as batch ladders with a reason column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.columns import empty_to_null, js_positive_id, js_round_cents, moment, touch
from lendlane.operators.feed import busy_flag
from lendlane.operators.gates import BOOKING_GATES, with_config
from lendlane.operators.skew import lookup_join

# Payment amount limits in cents, both allowed.
MIN_CENTS = 50
MAX_CENTS = 1_000_000


def spread_null_key(key: Column, row_id: str) -> Column:
    """A negative stand-in for a NULL id, so such rows do not all meet in one task.

    Ids in use are positive: the stand-in matches nothing.
    """
    return F.coalesce(key, F.lit(-1).cast("bigint") - F.pmod(F.xxhash64(row_id), F.lit(1_000_003)))


def guard_busy(requests: DataFrame, trailers: DataFrame, row_id: str = "id") -> DataFrame:
    """Requests with ``is_busy``: the listing is shown as taken and cannot be booked.

    Unknown listings pass.
    """
    flags = trailers.select(F.col("id").alias("_listing"), busy_flag().alias("_busy")).where("_busy")
    keyed = requests.withColumn("_key", spread_null_key(F.col("trailer_id"), row_id))
    return keyed.join(flags, F.col("_key") == F.col("_listing"), "left").select(
        *requests.columns, F.coalesce("_busy", F.lit(False)).alias("is_busy")
    )


def host_booking_gate(hosts: DataFrame, config: DataFrame, policy: str = "open") -> DataFrame:
    """Per host id text: country and whether it may be booked.  One row per host.

    Should a host id occur twice, the row with the lowest id counts.
    """
    one = hosts.groupBy("host_uid").agg(F.min_by("country_code", "id").alias("host_country"))
    return with_config(one, "host_country", config).select(
        "host_uid", "host_country", BOOKING_GATES[policy](F.col("host_country")).alias("can_book")
    )


def guard_country(
    requests: DataFrame,
    hosts: DataFrame,
    config: DataFrame,
    policy: str = "open",
    row_id: str = "id",
) -> DataFrame:
    """Requests with ``can_book`` and ``gate_country`` (the country, or 'unknown').

    The gate is worked out once per host; a host with very many requests is spread.
    """
    gate = host_booking_gate(hosts, config, policy)
    joined = lookup_join(requests, gate, ["host_uid"], [row_id])
    return joined.select(
        *requests.columns,
        # no such host is an unknown country: allowed when open, refused when denying
        F.coalesce("can_book", F.lit(policy == "open")).alias("can_book"),
        F.coalesce(empty_to_null("host_country"), F.lit("unknown")).alias("gate_country"),
    )


def booking_admission(
    requests: DataFrame,
    trailers: DataFrame,
    hosts: DataFrame,
    config: DataFrame,
    policy: str = "open",
    row_id: str = "id",
) -> DataFrame:
    """Requests with ``accepted`` and the ``reason`` of the first rule that fails.

    The busy guard is asked before the country gate.
    """
    # joined the other way round, as the country lookup counts the rows it is given
    checked = guard_busy(guard_country(requests, hosts, config, policy, row_id), trailers, row_id)
    reason = (
        F.when(F.col("is_busy"), F.lit("busy_listing"))
        .when(~F.col("can_book"), F.concat(F.lit("country_blocked ("), F.col("gate_country"), F.lit(")")))
        .otherwise(F.lit("ok"))
    )
    return checked.withColumn("reason", reason).select(
        *requests.columns, (F.col("reason") == "ok").alias("accepted"), "reason"
    )


def unpaid_busy_bookings(bookings: DataFrame, trailers: DataFrame, keep: bool = False) -> DataFrame:
    """Bookings without payment on busy-display listings; with ``keep``, all the others."""
    busy = trailers.where(busy_flag()).select(F.col("id").alias("_listing"))
    unpaid = F.coalesce("payment_status", F.lit("")) != "paid"
    on_busy = F.col("trailer_id") == F.col("_listing")
    return bookings.join(busy, on_busy & unpaid, "left_anti" if keep else "left_semi")


def _in_range(cents: Column) -> Column:
    return F.coalesce((cents >= MIN_CENTS) & (cents <= MAX_CENTS), F.lit(False))


def checkout_audit(requests: DataFrame, bookings: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Checkout requests with the first failing check and the amount in cents."""
    booked = bookings.select(
        F.col("id").alias("_booking"),
        F.col("currency").alias("_currency"),
        F.col("payment_status").alias("_paid"),
        js_round_cents("total_price").alias("_cents"),
    )
    asked = requests.withColumn("_id", js_positive_id("booking_id")).withColumn(
        "_key", spread_null_key(F.col("_id"), row_id)
    )
    outcome = (
        F.when(F.col("_id").isNull(), "bad_id")
        .when(F.col("_booking").isNull(), "not_found")
        .when(F.upper(F.coalesce("_currency", F.lit("EUR"))) != "EUR", "non_eur")
        .when(F.col("_paid") == "paid", "already_paid")
        .when(~_in_range(F.col("_cents")), "bad_amount")
        .otherwise("ok")
    )
    return (
        asked.join(booked, F.col("_key") == F.col("_booking"), "left")
        .withColumn("outcome", outcome)
        .select(
            *requests.columns,
            "outcome",
            F.when(F.col("outcome") == "ok", F.col("_cents")).alias("amount_cents"),
        )
    )


def checkout_line_item(bookings: DataFrame, brand: str) -> DataFrame:
    """Text of the payment line; an empty trailer type counts as missing."""
    kind = F.coalesce(empty_to_null("trailer_type"), F.lit("trailer"))
    number = F.coalesce(F.col("trailer_id"), F.col("id")).cast("string")
    return bookings.select(
        "id", F.concat(F.lit(f"{brand} rent — "), kind, F.lit(" #"), number).alias("line_item")
    )


def authorize_audit(requests: DataFrame) -> DataFrame:
    """Card authorisation requests: euro only, whole cents within the limits."""
    cents = F.col("_cents")
    outcome = (
        F.when(F.lower(F.coalesce("currency", F.lit("eur"))) != "eur", "non_eur")
        .when(~_in_range(cents), "bad_amount")
        .otherwise("ok")
    )
    # an amount within the limits is a whole number above zero, as an id is
    read = requests.withColumn("_cents", js_positive_id("amount")).withColumn("outcome", outcome)
    return read.select(
        *requests.columns, "outcome", F.when(F.col("outcome") == "ok", cents).alias("amount_cents")
    )


def cancel_fee_audit(requests: DataFrame) -> DataFrame:
    """Cancellation fees: a missing or non-positive fee is rejected, else captured."""
    good = F.coalesce(F.col("penalty_amount") > 0, F.lit(False))
    return requests.select(
        *requests.columns,
        F.when(good, "captured").otherwise("rejected").alias("outcome"),
        F.when(good, F.col("penalty_amount")).alias("captured_amount"),
    )


def session_link(bookings: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    """Write each new session id to its booking.  With several, the last by ``created_seq`` stays."""
    order = F.col("created_seq") if "created_seq" in sessions.columns else F.lit(0)
    last = sessions.groupBy(F.col("booking_id").alias("_booking")).agg(
        F.max_by("session_id", F.struct(order.alias("o"), F.col("session_id").alias("s"))).alias("_session")
    )
    linked = F.col("_booking").isNotNull()
    joined = bookings.join(last, F.col("id") == F.col("_booking"), "left")
    return joined.withColumns({
        "stripe_checkout_session_id": F.when(linked, F.col("_session")).otherwise(F.col("stripe_checkout_session_id")),
        "updated_at": touch(bookings, linked, moment(as_of)),
    }).select(*bookings.columns, *([] if "updated_at" in bookings.columns else ["updated_at"]))
