"""Country gates: may bookings be taken, may payouts be made.

One left join to the country configuration serves all gates.  The
configuration is keyed by country, so it never multiplies rows.  No broadcast
hint is given: Spark broadcasts it when its size is known to be under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where adaptive
execution splits a hot country on the left side.

The lookup key is upper-cased but not trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.operators.config import generated_mirrors

CONFIG_COLUMNS = [
    "currency", "country_status", "market_status", "booking_enabled", "payments_enabled",
    "payouts_enabled", "stripe_supported",
]


def with_config(df: DataFrame, country: str | Column, config: DataFrame, columns=CONFIG_COLUMNS) -> DataFrame:
    """``df`` with the matching configuration in ``cfg_*`` columns; all NULL if there is none."""
    country = F.col(country) if isinstance(country, str) else country
    lookup = config.select(
        F.col("country_code").alias("cfg_country_code"), *[F.col(c).alias(f"cfg_{c}") for c in columns]
    )
    return (
        df.withColumn("_lookup", F.upper(F.coalesce(country, F.lit(""))))
        .join(lookup, F.col("_lookup") == F.col("cfg_country_code"), "left")
        .drop("_lookup")
    )


def _blank(country: Column) -> Column:
    return country.isNull() | (F.trim(country) == "")


def booking_open(country: Column) -> Column:
    """Allowed unless the configuration says no.  Waitlisted countries are allowed."""
    blocked = (
        (F.col("cfg_country_status") == "DISABLED")
        | (F.col("cfg_booking_enabled") == F.lit(False))
        | (F.col("cfg_payments_enabled") == F.lit(False))
        | (F.col("cfg_stripe_supported") == F.lit(False))
    )
    return F.when(_blank(country), F.lit(True)).otherwise(F.coalesce(~blocked, F.lit(True)))


def booking_deny(country: Column) -> Column:
    """Allowed only where the configuration says yes; unknown countries are not."""
    allowed = (
        (F.col("cfg_country_status") == "ACTIVE")
        & F.col("cfg_booking_enabled") & F.col("cfg_payments_enabled") & F.col("cfg_stripe_supported")
    )
    return F.coalesce(allowed, F.lit(False))


def payout_open(country: Column) -> Column:
    blocked = (F.col("cfg_country_status") == "DISABLED") | (F.col("cfg_payouts_enabled") == F.lit(False))
    return F.when(_blank(country), F.lit(True)).otherwise(F.coalesce(~blocked, F.lit(True)))


def payout_deny(country: Column) -> Column:
    allowed = (F.col("cfg_country_status") == "ACTIVE") & F.col("cfg_payouts_enabled")
    return F.coalesce(allowed, F.lit(False))


BOOKING_GATES = {"open": booking_open, "deny": booking_deny}
PAYOUT_GATES = {"open": payout_open, "deny": payout_deny}


def _gate(df, country, config, rule, name) -> DataFrame:
    joined = with_config(df, country, config)
    return joined.select(*df.columns, rule(F.col(country)).alias(name))


def gate_booking(df: DataFrame, country: str, config: DataFrame, policy: str = "open", name: str = "can_book") -> DataFrame:
    return _gate(df, country, config, BOOKING_GATES[policy], name)


def gate_payout(df: DataFrame, country: str, config: DataFrame, policy: str = "open", name: str = "can_payout") -> DataFrame:
    return _gate(df, country, config, PAYOUT_GATES[policy], name)


# What the report says about a country without a configuration row.
REPORT_DEFAULTS = {
    "open": {"country_status": "ACTIVE", "market_status": "live", "reason": "Country is disabled by admin"},
    "deny": {"country_status": "DISABLED", "market_status": "blocked", "reason": "Country is not enabled yet"},
}


def host_gate_report(hosts: DataFrame, config: DataFrame, policy: str = "open") -> DataFrame:
    """Per host: may it be booked, in which country and currency, and why not."""
    fallback = REPORT_DEFAULTS[policy]
    can = BOOKING_GATES[policy](F.col("country_code"))
    # the open policy always charges in euro
    currency = F.lit("eur") if policy == "open" else F.lower(F.coalesce(F.col("cfg_currency"), F.lit("eur")))
    fields = {
        "can_book": can,
        "country_code": F.coalesce("cfg_country_code", F.upper(F.coalesce("country_code", F.lit("")))),
        "country_status": F.coalesce("cfg_country_status", F.lit(fallback["country_status"])),
        "market_status": F.coalesce("cfg_market_status", F.lit(fallback["market_status"])),
        "currency": currency,
        "reason": F.when(can, F.lit("OK")).otherwise(F.lit(fallback["reason"])),
    }
    joined = with_config(hosts.select("host_uid", "country_code"), "country_code", config)
    return joined.select(
        "host_uid",
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("gate"),
    )


def gate_report_columns(report: DataFrame) -> DataFrame:
    """The report's struct as flat columns."""
    return report.select("host_uid", "gate.*")


def gate_report_json(report: DataFrame) -> DataFrame:
    """The report's struct as a JSON document."""
    return report.select("host_uid", F.to_json("gate").alias("gate"))


# Report columns, in order, of the first and the current readiness view.
READINESS_FIRST = [
    "country_code", "country_name", "currency", "country_status", "tax_mode", "platform_fee_percent",
    "can_take_paid_booking", "can_payout", "payments_enabled", "payouts_enabled", "booking_enabled",
    "stripe_supported", "stripe_connect_supported", "stripe_tax_supported",
    "invoice_legal_note", "legal_entity", "updated_at",
]
READINESS_CURRENT = [
    "country_code", "country_name", "currency", "default_currency", "market_status", "country_status",
    "stripe_mode", "client_enabled", "host_enabled", "booking_enabled", "payments_enabled",
    "payment_enabled", "payouts_enabled", "payout_enabled", "stripe_supported",
    "stripe_connect_supported", "stripe_tax_supported", "can_take_paid_booking", "can_payout",
    "tax_mode", "platform_fee_percent", "invoice_legal_note", "legal_entity", "notes", "updated_at",
]


def country_readiness(config: DataFrame, policy: str = "open", form: str = "current") -> DataFrame:
    """Per country: all flags and both gates, sorted for reading.

    The gates look a country up in upper case, so a code stored in lower case may
    find another row than its own, or none.
    """
    joined = with_config(config, "country_code", config)
    code = F.col("country_code")
    full = generated_mirrors(joined).withColumns({
        "can_take_paid_booking": BOOKING_GATES[policy](code),
        "can_payout": PAYOUT_GATES[policy](code),
    })
    wanted = READINESS_CURRENT if form == "current" else READINESS_FIRST
    lead = "market_status" if form == "current" else "country_status"
    shown = full.select(*[c for c in wanted if c in full.columns])
    return shown.orderBy(F.col(lead).asc_nulls_last(), F.col("country_code").asc_nulls_last())


def market_status_counts(config: DataFrame) -> DataFrame:
    """Per market status: rows, rows in euro, rows with payouts on."""
    return (
        config.groupBy("market_status")
        .agg(
            F.count(F.lit(1)).alias("countries"),
            F.count_if(F.col("currency") == "eur").alias("in_euro"),
            F.count_if(F.col("payouts_enabled")).alias("payouts_on"),
            F.count_if(F.col("market_status") != "live").alias("not_live"),
        )
        .orderBy(F.col("market_status").asc_nulls_last())
    )
