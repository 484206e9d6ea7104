from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lendlane.sources import tables
from lendlane.sources.golden import SCHEMAS, golden
from lendlane.sources.store import conform

BOOKINGS = tables.TABLE_SCHEMAS["bookings"]


def test_filter_and_columns_reach_the_scan(spark, frame, tmp_path):
    path = str(tmp_path / "hosts")
    spark.createDataFrame([(i, f"h{i}", "e", "n", "p", "EE", None, True) for i in range(9)], tables.TABLE_SCHEMAS["hosts"]).write.parquet(path)
    df = tables.read_table(spark, path, tables.TABLE_SCHEMAS["hosts"], ["id", "country_code"], F.col("host_uid") == "h3")
    assert [tuple(r) for r in df.collect()] == [(3, "EE")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(host_uid,h3)" in plan and "full_name" not in plan


def test_later_months_are_not_read(spark, frame, tmp_path):
    path = str(tmp_path / "bookings")
    made = spark.createDataFrame([], BOOKINGS).select("id", "start_at")
    rows = frame("id bigint, start_at timestamp_ntz", (1, "2026-05-31"), (2, "2026-06-30"), (3, "2026-07-01"), (4, "2025-12-01"))
    tables.write_bookings(made.unionByName(rows), path)
    df = tables.read_bookings_until(spark, path, "2026-06-15 00:00:00")
    assert sorted(r.id for r in df.collect()) == [1, 2, 4]
    at = tables.read_bookings_until(spark, path, datetime(2026, 6, 15))
    assert sorted(r.id for r in at.collect()) == [1, 2, 4]
    assert df.columns == [f.split()[0] for f in BOOKINGS.replace("\n", " ").split(", ")]
    assert "start_month#" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


@pytest.mark.parametrize("name,rows", [("country_base", 43), ("country_markets", 51), ("city_centres", 171), ("city_offsets", 6)])
def test_golden_dimensions(spark, name, rows):
    df = golden(spark, name)
    assert df.count() == rows and df.columns == spark.createDataFrame([], SCHEMAS[name]).columns
    assert df.dropna("any").count() == rows


def test_only_months_asked_for_are_opened(spark, frame, tmp_path):
    """The months are known at run time only: a broken file of another month is never opened."""
    from lendlane.operators.listings import expiry_months

    rows = frame("id bigint, start_at timestamp_ntz", (1, "2026-05-03"), (2, "2026-06-01"), (3, "2026-06-30"), (4, "2026-07-01"), (5, None))
    path = f"{tmp_path}/bookings"
    tables.write_bookings(conform(rows, tables.TABLE_SCHEMAS["bookings"]), path)
    (tmp_path / "bookings" / "start_month=2026-05" / "broken.parquet").write_bytes(b"no parquet at all")
    trailers = frame("id bigint, starter_expires_at timestamp_ntz", (1, "2026-06-05"), (2, "2026-06-09"), (3, "2026-05-05"), (4, None))
    found = tables.read_bookings_of(spark, path, expiry_months(trailers, "2026-06-01 00:00:00"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in found.select("id").collect()) == [2, 3]
    assert tables.read_bookings_of(spark, path, expiry_months(trailers, "2027-01-01 00:00:00")).count() == 0
