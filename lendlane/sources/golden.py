"""The golden dimensions that ship with the package, as DataFrames."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

DATA = Path(__file__).resolve().parent.parent / "data"

SCHEMAS = {
    "country_base": "country_code string, country_name string, currency string",
    "country_markets": """country_code string, country_name string, currency string, market_status string,
        country_status string, client_enabled boolean, host_enabled boolean, booking_enabled boolean,
        payments_enabled boolean, payouts_enabled boolean, stripe_supported boolean,
        stripe_connect_supported boolean, stripe_mode string, notes string""",
    "city_centres": "loc string, clat decimal(10,6), clng decimal(10,6)",
    "city_offsets": "i bigint, dlat decimal(10,6), dlng decimal(10,6)",
}

# Fixed value: the note on markets whose hosts are paid by hand.
MANUAL_PAYOUT_NOTE = "Global EUR live market. Host payout requires separate verification/manual payout."


def golden(spark: SparkSession, name: str) -> DataFrame:
    """One packaged dimension.  At most 171 rows, read on the driver: executors need no file."""
    with open(DATA / f"{name}.csv", encoding="utf-8", newline="") as f:
        lines = [line for line in f if not line.startswith("#")]
    rows = list(csv.reader(lines))
    text = spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"{c} string" for c in rows[0]))
    target = spark.createDataFrame([], SCHEMAS[name]).schema
    return text.select(*[F.col(f.name).cast(f.dataType) for f in target.fields])


def global_euro_markets(markets: DataFrame) -> DataFrame:
    """The market list once all markets are live in euro.

    Everything opens but payouts, which stay with the markets that were live
    before; account support and mode stay as they are.
    """
    return markets.withColumns({
        "notes": F.when(F.col("market_status") == "live", F.col("notes")).otherwise(F.lit(MANUAL_PAYOUT_NOTE)),
        "currency": F.lit("eur"),
        "market_status": F.lit("live"),
        "country_status": F.lit("ACTIVE"),
        **{c: F.lit(True) for c in ("client_enabled", "host_enabled", "booking_enabled", "payments_enabled", "stripe_supported")},
    })
