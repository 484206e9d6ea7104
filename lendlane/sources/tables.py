"""Declared schemas of the marketplace tables, and how they are read and written."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLE_SCHEMAS = {
    "country_config": """country_code string, country_name string, currency string, tax_mode string,
        vat_rate decimal(5,2), stripe_supported boolean, stripe_connect_supported boolean,
        stripe_tax_supported boolean, platform_fee_percent decimal(5,2), payments_enabled boolean,
        payouts_enabled boolean, booking_enabled boolean, client_enabled boolean, host_enabled boolean,
        country_status string, market_status string, stripe_mode string, notes string,
        invoice_legal_note string, legal_entity string, updated_at timestamp_ntz""",
    "hosts": """id bigint, host_uid string, email string, full_name string, phone_number string,
        country_code string, stripe_account_id string, payouts_enabled boolean""",
    "trailers": """id bigint, host_id bigint, host_uid string, trailername string, model string,
        trailer_type string, main_category string, subtype string, description string, capacity_kg int,
        dimensions_m string, axles string, color string, thumbnail string, photos map<string,string>,
        latitude decimal(10,6), longitude decimal(10,6), location_name string, price_per_hr decimal(10,2),
        currency string, requires_approval boolean, has_insurance boolean, is_available boolean,
        busy_display boolean, verified boolean, delivery_available boolean, insurance_status string,
        status string, starter_expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "pricing_profiles": """id bigint, trailer_id bigint, host_id bigint, name string, is_active boolean,
        currency string, hourly_rate decimal(10,2), short_rental_price decimal(10,2), daily_rate decimal(10,2),
        weekly_rate decimal(10,2), monthly_rate decimal(10,2), min_hours int, min_days int,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "bookings": """id bigint, trailer_id bigint, host_uid string, trailer_type string, status string,
        payment_status string, total_price decimal(16,5), currency string, start_at timestamp_ntz,
        end_at timestamp_ntz, stripe_customer_id string, stripe_checkout_session_id string,
        stripe_payment_intent_id string, host_payout_amount decimal(16,5), payout_status string,
        payout_due_at timestamp_ntz, payout_transfer_id string, updated_at timestamp_ntz""",
    "host_payouts": """host_uid string, booking_id bigint, amount decimal(16,5), status string,
        transfer_id string, created_at timestamp_ntz""",
    "app_version_config": """app string, min_build int, latest_build int, force_update boolean,
        android_url string, ios_url string, updated_at timestamp_ntz""",
    "payment_events": """event_id bigint, ts timestamp_ntz, type string, booking_id string,
        payment_status string, session_id string, payment_intent string""",
}


def read_table(
    spark: SparkSession,
    path: str,
    schema: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Parquet with a declared schema, a column list and a filter; both reach the scan."""
    df = spark.read.schema(schema).parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def write_bookings(bookings: DataFrame, path: str) -> None:
    """Bookings partitioned by the month they start in.

    Ranges over month and id give each task a share of one month or a few: neither
    one file per task and month, nor one task for a busy month.
    """
    monthly = bookings.withColumn("start_month", F.date_format("start_at", "yyyy-MM"))
    monthly.repartitionByRange("start_month", "id").write.mode("append").partitionBy("start_month").parquet(path)


def read_bookings_until(spark: SparkSession, path: str, as_of: str | datetime) -> DataFrame:
    """Bookings starting no later than the month of ``as_of``; later partitions are not read.

    Nothing bounds how long a rental lasts, so earlier months are not cut off.
    """
    df = spark.read.schema(TABLE_SCHEMAS["bookings"] + ", start_month string").parquet(path)
    month = as_of.strftime("%Y-%m") if isinstance(as_of, datetime) else as_of[:7]
    return df.where(F.col("start_month") <= month).drop("start_month")


def read_bookings_of(spark: SparkSession, path: str, months: DataFrame) -> DataFrame:
    """Bookings starting in one of ``months`` (``start_month`` as ``yyyy-MM``, repeats allowed).

    Distinct months are twelve a year, which bounds the broadcast.  Where ``months`` comes through a
    filter, the scan asks for them before it lists files, and opens no others.
    """
    df = spark.read.schema(TABLE_SCHEMAS["bookings"] + ", start_month string").parquet(path)
    wanted = months.where(F.col("start_month").rlike("^[0-9]{4}-[0-9]{2}$")).select("start_month").distinct()
    return df.join(F.broadcast(wanted), "start_month", "left_semi").drop("start_month")
