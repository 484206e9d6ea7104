import random
from datetime import datetime, timedelta

from lendlane.operators.availability import free_spans

T0 = datetime(2026, 7, 1)
KIND = "id bigint, trailer_id bigint, status string, start_at timestamp_ntz, end_at timestamp_ntz"


def brute(listings, bookings, low, high):
    """Minute by minute."""
    out = set()
    for listing in listings:
        free_from, at = None, low
        while at <= high:
            free = at < high and not any(
                t == listing and (s or "").lower() in ("paid_confirmed", "in_progress") and a <= at < b
                for _, t, s, a, b in bookings if a is not None and b is not None)
            if free and free_from is None:
                free_from = at
            if not free and free_from is not None:
                out.add((listing, free_from, at))
                free_from = None
            at += timedelta(minutes=1)
    return out


def test_free_spans_equal_a_minute_by_minute_count(frame):
    rng = random.Random(5)
    for width in (1, 7, 60, 10_000):
        bookings = []
        for i in range(120):
            start = rng.randrange(-40, 200)
            end = start + rng.choice([0, -3, 1, 5, 12, 12, 60])
            bookings.append((i, rng.choice([1, 1, 1, 2, 3, 99, None]), rng.choice(["Paid_Confirmed", "in_progress", "cancelled", None]),
                             T0 + timedelta(minutes=start), T0 + timedelta(minutes=end)))
        bookings += [(900, 2, "in_progress", None, T0), (901, 2, "in_progress", T0, None), bookings[0]]
        high = T0 + timedelta(minutes=150)
        df = frame(KIND, *bookings)
        got = free_spans(frame("id bigint", (1,), (2,), (3,), (4,)), df, T0.isoformat(" "), high.isoformat(" "), width)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute([1, 2, 3, 4], bookings, T0, high), width


def test_no_listings_no_bookings(frame):
    since, until = "2026-07-01 00:00:00", "2026-07-02 00:00:00"
    none = frame(KIND)
    assert free_spans(frame("id bigint"), none, since, until).count() == 0
    assert [tuple(r) for r in free_spans(frame("id bigint", (7,)), none, since, until).collect()] == [(7, T0, T0 + timedelta(days=1))]


def test_a_hot_listing_is_swept_in_slices(spark):
    """No window holds more than a slice of the listing with most of the rentals."""
    rentals = spark.range(20_000).selectExpr(
        "id", "if(id % 3 = 0, 1L, id % 50) as trailer_id", "'in_progress' as status",
        "timestamp_ntz'2026-07-01' + make_dt_interval(0, 0, 0, id * 60) as start_at",
        "timestamp_ntz'2026-07-01' + make_dt_interval(0, 0, 0, id * 60 + 30) as end_at")
    listings = spark.range(1, 3)
    spans = free_spans(listings, rentals, "2026-07-01 00:00:00", "2026-07-20 00:00:00")
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(trailer_id" in plan and "_slice" in plan
    alone = rentals.where("trailer_id = 1 and start_at < timestamp_ntz'2026-07-15'").count()
    # rentals of a listing never touch, so each is followed by a free span; the first starts with the interval
    assert spans.where("trailer_id = 1").count() == rentals.where("trailer_id = 1").count() >= alone
