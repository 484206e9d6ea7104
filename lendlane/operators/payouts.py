"""Host payouts: what is due, what to transfer, and the books afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlane.functions.columns import empty_to_null, js_round_cents, moment
from lendlane.operators.gates import with_config
from lendlane.operators.skew import lookup_join


def unique_hosts(hosts: DataFrame, columns: list[str]) -> DataFrame:
    """Hosts by ``host_uid``; an id that occurs twice counts as not there."""
    grouped = hosts.groupBy("host_uid").agg(
        F.count(F.lit(1)).alias("_rows"), F.any_value(F.struct(*columns)).alias("_host")
    )
    return grouped.where((F.col("_rows") == 1) & F.col("host_uid").isNotNull()).select(
        "host_uid", *[F.col(f"_host.{c}").alias(c) for c in columns]
    )


def payout_due(bookings: DataFrame, as_of) -> DataFrame:
    """Completed bookings whose payout is pending and due.  States are compared exactly."""
    return bookings.where(
        (F.col("status") == "completed")
        & (F.col("payout_status") == "pending")
        & (F.col("payout_due_at") <= moment(as_of))
    )


def payout_hosts(hosts: DataFrame, config: DataFrame) -> DataFrame:
    """Per host: account, country, whether payouts are blocked there, and the currency set for it."""
    known = unique_hosts(hosts, ["stripe_account_id", "country_code"])
    blocked = (F.col("cfg_country_status") == "DISABLED") | (F.col("cfg_payouts_enabled") == F.lit(False))
    return with_config(known, "country_code", config).select(
        "host_uid",
        empty_to_null("stripe_account_id").alias("host_account"),
        F.upper(F.coalesce("country_code", F.lit(""))).alias("host_country"),
        F.coalesce(blocked, F.lit(False)).alias("host_blocked"),
        F.col("cfg_currency").alias("host_currency"),
    )


def payout_plan(
    bookings: DataFrame,
    hosts: DataFrame,
    config: DataFrame,
) -> DataFrame:
    """What to do with each given booking: the first rule that stops it, else a transfer.

    The host table is resolved against the configuration once per host; bookings
    then need one join, in which a host with very many bookings is spread.
    """
    wanted = bookings.select("id", "host_uid", "host_payout_amount", "payout_status", "currency")
    joined = lookup_join(wanted, payout_hosts(hosts, config), ["host_uid"], ["id"])
    cents = js_round_cents(F.coalesce(F.col("host_payout_amount"), F.lit(0)))
    outcome = (
        F.when(F.col("payout_status") == "paid", "already_paid")
        .when(cents <= 0, "no_amount")
        .when(F.col("host_account").isNull(), "no_account")
        .when(F.col("host_blocked"), "country_blocked")
        .otherwise("transfer")
    )
    go = F.col("outcome") == "transfer"
    return joined.withColumn("outcome", outcome).select(
        F.col("id").alias("booking_id"),
        "host_uid",
        "outcome",
        cents.alias("amount_cents"),
        F.when(go, F.lower(F.coalesce("host_currency", "currency", F.lit("eur")))).alias("transfer_currency"),
        F.when(go, F.col("host_account")).alias("destination"),
        F.when(F.col("outcome") == "country_blocked", F.col("host_country")).alias("blocked_country"),
    )


def payout_plan_manual(
    bookings: DataFrame, requested: DataFrame, hosts: DataFrame, config: DataFrame
) -> DataFrame:
    """Plan for chosen booking ids, due or not: failed payouts can be tried again here."""
    chosen = bookings.join(requested.select(F.col("booking_id").alias("_asked")), F.col("id") == F.col("_asked"), "left_semi")
    return payout_plan(chosen, hosts, config)


def _results(results: DataFrame) -> DataFrame:
    """One result per booking; should there be several, a success stands."""
    return results.groupBy(F.col("booking_id").alias("_booking")).agg(
        F.max(F.struct("ok", "transfer_id")).alias("_r")
    )


def payout_settle(bookings: DataFrame, results: DataFrame) -> DataFrame:
    """Bookings after the transfers: paid with the transfer's id, or failed."""
    hit, ok = F.col("_booking").isNotNull(), F.coalesce(F.col("_r.ok"), F.lit(False))
    transfer = F.col("payout_transfer_id") if "payout_transfer_id" in bookings.columns else F.lit(None).cast("string")
    joined = bookings.join(_results(results), F.col("id") == F.col("_booking"), "left")
    return joined.withColumns({
        "payout_status": F.when(hit & ok, "paid").when(hit, "failed").otherwise(F.col("payout_status")),
        "payout_transfer_id": F.when(hit & ok, F.col("_r.transfer_id")).otherwise(transfer),
    }).select(*bookings.columns, *([] if "payout_transfer_id" in bookings.columns else ["payout_transfer_id"]))


def payout_ledger_append(bookings: DataFrame, results: DataFrame, ledger: DataFrame | None, as_of) -> DataFrame:
    """New ledger rows: one per paid transfer whose booking is not in the ledger yet."""
    paid = _results(results).where(F.col("_r.ok"))
    rows = bookings.join(paid, F.col("id") == F.col("_booking")).select(
        "host_uid",
        F.col("id").alias("booking_id"),
        F.col("host_payout_amount").alias("amount"),
        F.lit("paid").alias("status"),
        F.col("_r.transfer_id").alias("transfer_id"),
        moment(as_of).alias("created_at"),
    )
    if ledger is None:
        return rows
    return rows.join(ledger.select("booking_id").distinct(), "booking_id", "left_anti").select(*rows.columns)


def write_ledger(rows: DataFrame, path: str) -> None:
    """Append to the Parquet ledger."""
    rows.write.mode("append").parquet(path)


def payout_run_summary(plan: DataFrame) -> DataFrame:
    """Bookings and cents per outcome, and over all as ``processed``."""
    return plan.rollup("outcome").agg(
        F.count(F.lit(1)).alias("bookings"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("amount_cents")
    ).withColumn("outcome", F.coalesce("outcome", F.lit("processed")))
