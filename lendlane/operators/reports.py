"""Reports over hosts, countries and bookings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.operators.gates import with_config
from lendlane.operators.payouts import unique_hosts


def market_tier(code: str, connect: str, currency: str) -> Column:
    """Tier of a country by its configuration; unlisted where there is none."""
    return (
        F.when(F.col(code).isNull(), "unlisted")
        .when(~F.coalesce(F.col(connect), F.lit(False)), "manual_payout")
        .when(F.lower(currency) == "eur", "euro_auto_payout")
        .otherwise("live_non_euro")
    )


def market_tier_rollup(config: DataFrame, hosts: DataFrame, bookings: DataFrame) -> DataFrame:
    """Countries, hosts and booking value per tier.

    Bookings are summed per host before they meet the hosts, so no host is hot.  Bookings whose host
    is NULL or unknown count as unlisted, so the tiers add up to all bookings.
    """
    of_country = market_tier("country_code", "stripe_connect_supported", "currency")
    countries = config.groupBy(of_country.alias("tier")).agg(F.count(F.lit(1)).alias("countries"))
    of_host = market_tier("cfg_country_code", "cfg_stripe_connect_supported", "cfg_currency")
    value = bookings.groupBy("host_uid").agg(F.sum("total_price").alias("value"), F.count(F.lit(1)).alias("n"))
    known = hosts.groupBy("host_uid").agg(F.min_by("country_code", "id").alias("country_code"), F.lit(1).alias("known"))
    per_tier = (
        with_config(known.join(value, "host_uid", "full"), "country_code", config, ["currency", "stripe_connect_supported"])
        .groupBy(of_host.alias("tier"))
        .agg(
            F.count("known").alias("hosts"),
            F.sum(F.coalesce("n", F.lit(0))).alias("bookings"),
            F.sum("value").alias("booking_value"),
        )
    )
    return countries.join(per_tier, "tier", "full_outer").select(
        "tier",
        F.coalesce("countries", F.lit(0)).alias("countries"),
        F.coalesce("hosts", F.lit(0)).alias("hosts"),
        F.coalesce("bookings", F.lit(0)).alias("bookings"),
        F.coalesce("booking_value", F.lit(0)).cast("decimal(36,5)").alias("booking_value"),
    )


def held_host_balance(bookings: DataFrame, hosts: DataFrame) -> DataFrame:
    """Earnings of completed bookings not paid out yet, per host, with its country."""
    held = (
        bookings.where((F.col("status") == "completed") & (F.coalesce("payout_status", F.lit("")) != "paid"))
        .groupBy("host_uid")
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.coalesce(F.sum("host_payout_amount"), F.lit(0)).cast("decimal(36,5)").alias("held_amount"),
        )
    )
    return held.join(unique_hosts(hosts, ["country_code"]), "host_uid", "left").select(
        "host_uid", "country_code", "bookings", "held_amount"
    )
