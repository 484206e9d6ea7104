"""Payment events: one outcome per event, and the bookings after applying them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlane.functions.columns import empty_to_null, js_positive_id, moment, touch
from lendlane.operators.skew import lookup_join

# Event types that confirm or refuse a payment.
SUCCESS_TYPES = ["checkout.session.completed", "checkout.session.async_payment_succeeded"]
FAILURE_TYPE = "checkout.session.async_payment_failed"


def payment_intent_extract(events: DataFrame, column: str = "payment_intent") -> DataFrame:
    """``payment_intent_id`` from JSON text that is either the id or an object holding it."""
    raw = F.col(column)
    inner = F.get_json_object(raw, "$.id")
    return events.withColumn("payment_intent_id", F.when(raw.startswith("{"), inner).otherwise(raw))


def parse_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Event JSON to flat columns."""
    def at(path: str) -> Column:
        return F.get_json_object(F.col(body), path)

    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    flat = raw.select(
        F.col("event_id") if "event_id" in raw.columns else at("$.id").alias("event_id"),
        F.col("ts") if "ts" in raw.columns
        else (epoch + F.make_dt_interval(secs=at("$.created").try_cast("decimal(18,6)"))).alias("ts"),
        at("$.type").alias("type"),
        at("$.data.object.metadata.booking_id").alias("booking_id"),
        at("$.data.object.payment_status").alias("payment_status"),
        at("$.data.object.id").alias("session_id"),
        at("$.data.object.currency").alias("currency"),
        at("$.data.object.payment_intent").alias("payment_intent"),
    )
    return payment_intent_extract(flat).drop("payment_intent")


def _confirms() -> Column:
    return F.coalesce(F.col("type").isin(SUCCESS_TYPES), F.lit(False))


def _is_paid() -> Column:
    return F.coalesce(F.col("payment_status") == "paid", F.lit(False))


def pending_events(events: DataFrame) -> DataFrame:
    """Events that may confirm a booking, with its id in ``_booking``: -1 if unreadable.

    A missing session counts as an empty one: both differ from any stored session,
    and neither binds.  Both columns are never NULL, to the optimizer too, so that
    the steps below share one shuffle.
    """
    return events.where(_confirms() & _is_paid()).select(
        *events.columns,
        F.coalesce(js_positive_id("booking_id"), F.lit(-1)).alias("_booking"),
        F.coalesce("session_id", F.lit("")).alias("_session"),
    )


def settled_events(events: DataFrame) -> DataFrame:
    """Outcomes of the other events: no booking needs to be looked up for them."""
    outcome = (
        F.when(F.col("type") == FAILURE_TYPE, "failed")
        .when(~_confirms(), "ignored")
        .when(js_positive_id("booking_id").isNull(), "bad_metadata")
        .otherwise("awaiting_payment")
    )
    return events.where(~(_confirms() & _is_paid())).select(*events.columns, outcome.alias("outcome"))


def _deciding_state(pending: DataFrame, bookings: DataFrame) -> DataFrame:
    """Per booking with pending events: what it is bound to and which event wins.

    All steps are aggregates that combine map-side, or joins of tables unique on
    the join key, so a booking or session with very many events costs no
    more than any other.
    """
    firsts = pending.groupBy("_booking", "_session").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    per_booking = firsts.groupBy("_booking").agg(
        F.min(F.struct("first.ts", "first.event_id", "_session")).alias("first_any")
    )
    stored = bookings.select(
        F.col("id").alias("_booking"),
        F.lit(True).alias("known"),
        empty_to_null("stripe_checkout_session_id").alias("stored_session"),
        _is_paid().alias("was_paid"),
    )
    first_of_session = firsts.select("_booking", F.col("_session").alias("stored_session"), F.col("first").alias("first_bound"))
    state = per_booking.join(stored, "_booking", "left").join(first_of_session, ["_booking", "stored_session"], "left")
    unbound = F.col("stored_session").isNull()
    first_any = F.struct(F.col("first_any.ts").alias("ts"), F.col("first_any.event_id").alias("event_id"))
    return state.select(
        "_booking",
        "known",
        # a booking that starts paid never binds a session
        F.when(F.col("was_paid") | ~unbound, F.col("stored_session"))
        .otherwise(empty_to_null(F.col("first_any._session"))).alias("bound"),
        F.when(~F.col("was_paid"), F.when(unbound, first_any).otherwise(F.col("first_bound"))).alias("winner"),
    )


def payment_event_classify(
    events: DataFrame, bookings: DataFrame, keep_booking: bool = False
) -> DataFrame:
    """One outcome per event, as if events were handled one by one by (ts, event_id).

    For a booking not paid yet, the first fitting event is applied and binds its
    session, unless a session is stored already.  Events of another session are
    mismatches, the rest duplicates.  ``(ts, event_id)`` names a delivery; it may come several
    times, and one copy of it is applied at most.  With
    ``keep_booking`` the parsed id of pending events stays in ``_booking``.
    """
    pending = pending_events(events)
    joined = lookup_join(pending, _deciding_state(pending, bookings), ["_booking"], ["event_id"])
    mine = F.struct("ts", "event_id")
    outcome = (
        F.when(F.col("_booking") == -1, "bad_metadata")
        .when(F.col("known").isNull(), "unknown_booking")
        .when(F.coalesce(F.col("winner") == mine, F.lit(False)) & (F.col("_session") == F.coalesce("bound", F.lit(""))), "applied")
        .when(F.col("_session") != F.col("bound"), "session_mismatch")
        .otherwise("duplicate")
    )
    decided = joined.select(*events.columns, "_booking", outcome.alias("outcome"))
    decided = decided.where(F.col("outcome") != "applied").unionByName(_applied_once(decided, events.columns))
    if not keep_booking:
        decided = decided.drop("_booking")
    return decided.unionByName(settled_events(events), allowMissingColumns=True)


def _applied_once(decided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The winning deliveries: one of their copies stays ``applied``, the others are duplicates.

    Copies are counted first, so only one row per winner and task is shuffled.
    """
    copies = decided.where(F.col("outcome") == "applied").groupBy(*columns, "_booking").agg(F.count(F.lit(1)).alias("_n"))
    first = F.row_number().over(Window.partitionBy("_booking").orderBy(F.xxhash64(*columns)))
    each = copies.withColumn("_first", first == 1).select(*columns, "_booking", "_first", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"))
    outcome = F.when(F.col("_first") & (F.col("_copy") == 1), "applied").otherwise("duplicate")
    return each.select(*columns, "_booking", outcome.alias("outcome"))


def payment_apply(bookings: DataFrame, classified: DataFrame, as_of) -> DataFrame:
    """Bookings after the ``applied`` events: paid, confirmed, linked.  Price and currency never change."""
    intent = F.col("payment_intent_id") if "payment_intent_id" in classified.columns else F.lit(None).cast("string")
    booking = F.col("_booking") if "_booking" in classified.columns else js_positive_id("booking_id")
    applied = (
        classified.where(F.col("outcome") == "applied").groupBy(booking.alias("_booking"))
        .agg(F.min(F.struct("ts", "event_id", F.col("session_id").alias("session"), intent.alias("intent"))).alias("_e"))
    )
    hit = F.col("_booking").isNotNull()

    def column(name: str) -> Column:
        return F.col(name) if name in bookings.columns else F.lit(None).cast("string")

    joined = bookings.join(applied, F.col("id") == F.col("_booking"), "left")
    new = {
        "payment_status": F.when(hit, F.lit("paid")).otherwise(F.col("payment_status")),
        "status": F.when(hit, F.lit("paid_confirmed")).otherwise(F.col("status")),
        "stripe_payment_intent_id": F.when(hit, F.col("_e.intent")).otherwise(column("stripe_payment_intent_id")),
        "stripe_checkout_session_id": F.when(hit, F.col("_e.session")).otherwise(F.col("stripe_checkout_session_id")),
        "updated_at": touch(bookings, hit, moment(as_of)),
    }
    added = [c for c in new if c not in bookings.columns]
    return joined.withColumns(new).select(*bookings.columns, *added)


def payment_event_counts(classified: DataFrame) -> DataFrame:
    return (
        classified.groupBy("type", "outcome").agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("type").asc_nulls_last(), "outcome")
    )
