"""Jobs made of several operators in a fixed order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from lendlane.operators.payments import payment_apply, payment_event_classify, payment_intent_extract
from lendlane.operators.payouts import payout_due, payout_ledger_append, payout_plan, payout_settle
from lendlane.operators.pricing import (
    deactivate_duplicates, one_active_fold, orphan_profiles, price_floor, price_sync,
)


class Prices(NamedTuple):
    trailers: DataFrame
    profiles: DataFrame


class Replay(NamedTuple):
    outcomes: DataFrame
    bookings: DataFrame


class PayoutRun(NamedTuple):
    plan: DataFrame
    bookings: DataFrame
    ledger_rows: DataFrame


def profile_insert_pipeline(profiles: DataFrame) -> DataFrame:
    """Profiles as inserted one by one: the floor comes first, then the one-active rule."""
    return one_active_fold(price_floor(profiles))


def reconcile_prices(
    trailers: DataFrame, profiles: DataFrame, as_of
) -> Prices:
    """The repair chain: one active profile each, default profiles, floors, then listing prices.

    New default profiles have no id here: storage gives it to them.
    """
    single = deactivate_duplicates(profiles, as_of)
    created = orphan_profiles(trailers, profiles, as_of)
    shared = [F.col(c).cast(profiles.schema[c].dataType) for c in created.columns if c in profiles.columns]
    complete = single.unionByName(created.select(*shared), allowMissingColumns=True)
    floored = price_floor(complete, as_of)
    return Prices(price_sync(trailers, floored), floored)


def payment_replay(
    events: DataFrame, bookings: DataFrame, as_of
) -> Replay:
    """All events judged, and the bookings they leave behind."""
    outcomes = payment_event_classify(events, bookings, keep_booking=True)
    if "payment_intent" in events.columns:
        outcomes = payment_intent_extract(outcomes)
    return Replay(outcomes.drop("_booking"), payment_apply(bookings, outcomes, as_of))


def payout_run(
    bookings: DataFrame, hosts: DataFrame, config: DataFrame, results: DataFrame, ledger: DataFrame | None, as_of,
) -> PayoutRun:
    """What is due, the bookings after the given transfer results, and new ledger rows."""
    plan = payout_plan(payout_due(bookings, as_of), hosts, config)
    return PayoutRun(plan, payout_settle(bookings, results), payout_ledger_append(bookings, results, ledger, as_of))
