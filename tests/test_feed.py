from pyspark.sql import functions as F
from tests.conftest import as_dicts, column

from lendlane.operators import feed

NOW = "2026-07-06 12:00:00"
TRAILER = (
    "id bigint, trailername string, status string, is_available boolean, busy_display boolean,"
    " latitude decimal(10,6), longitude decimal(10,6), currency string, price_per_hr decimal(10,2)"
)
PROFILE = (
    "id bigint, trailer_id bigint, name string, is_active boolean, currency string, short_rental_price decimal(10,2),"
    " daily_rate decimal(10,2), weekly_rate decimal(10,2), monthly_rate decimal(10,2)"
)
BOOKING = "id bigint, trailer_id bigint, status string, start_at timestamp_ntz, end_at timestamp_ntz"


def trailer(id, status="active", available=True, busy=None, currency=None):
    return (id, f"t{id}", status, available, busy, "59.4349", "24.7536", currency, 5)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_rented_window_is_half_open(frame):
    bookings = frame(
        BOOKING,
        (1, 1, "paid_confirmed", NOW, "2026-07-07"), (2, 2, "IN_PROGRESS", "2026-07-01", NOW),
        (3, 3, "In_Progress", "2026-07-01", "2026-07-06 12:00:01"), (4, 4, "completed", "2026-07-01", "2026-07-09"),
        (5, 5, None, "2026-07-01", "2026-07-09"), (6, 6, "in_progress", "2026-07-01", None),
        (7, 1, "paid_confirmed", "2026-07-05", "2026-07-08"), (8, None, "in_progress", "2026-07-01", "2026-07-09"),
        (9, 9, "paid_confirmed", "2026-07-07", "2026-07-08"),
    )
    assert sorted(r.trailer_id for r in feed.currently_rented(bookings, NOW).collect()) == [1, 3]


def test_feeds(frame):
    trailers = frame(
        TRAILER, trailer(1), trailer(2, "ACTIVE"), trailer(3, None), trailer(4, available=None, busy=True),
        trailer(5, available=False, busy=True), trailer(6, available=False), trailer(7, busy=True),
        trailer(8, "inactive", False, True), trailer(9),
    )
    bookings = frame(BOOKING, (1, 9, "in_progress", "2026-07-01", "2026-08-01"), (2, 5, "in_progress", "2026-07-01", "2026-08-01"))
    profiles = frame(
        PROFILE, (1, 1, "a", True, "SEK", 1, 2, 3, 4), (2, 1, "b", True, None, 1, 2, 3, 4),
        (3, 2, "c", None, "SEK", 1, 2, 3, 4), (4, 5, "d", True, None, 1, 2, 3, 4),
    )
    first = feed.public_feed_available(trailers, profiles, bookings, NOW)
    second = feed.public_feed_busy(trailers, profiles, bookings, NOW)
    current = feed.public_feed_current(trailers, profiles, bookings, NOW)
    # listing 1 comes twice: it has two active profiles
    assert ids(first) == [1, 1, 2, 7]
    assert ids(second) == ids(current) == [1, 1, 2, 4, 5, 7]
    assert "is_busy" not in first.columns
    shared = first.columns
    assert first.exceptAll(second.select(*shared)).count() == 0
    assert column(current, "is_busy") == {1: False, 2: False, 4: True, 5: True, 7: False}
    assert column(current, "latitude") == {1: 59.43, 2: 59.43, 4: 59.4349, 5: 59.4349, 7: 59.4349}
    assert set(column(second, "latitude").values()) == {59.43}
    assert sorted(r.currency for r in current.where("id = 1").collect()) == ["EUR", "SEK"]
    # NULL counts as not active in the feed
    assert current.where("id = 2").first().short_rental_price is None
    assert as_dicts(feed.busy_share(current)) == [{"busy": 2, "total": 6}]


def test_price_list_counts_null_as_active(frame):
    trailers = frame(TRAILER, trailer(1), trailer(2))
    profiles = frame(PROFILE, (1, 1, "a", None, "SEK", 1, 2, 3, 4), (2, 1, "b", True, None, 1, 2, 3, 4), (3, 2, "c", False, "SEK", 1, 2, 3, 4))
    rows = feed.effective_price_list(trailers, profiles).collect()
    assert [(r.id, r.profile_id) for r in rows] == [(1, 1), (1, 2), (2, None)]


def test_left_join_keeps_a_very_repeated_key(frame, spark):
    trailers = frame("id bigint", (1,), (2,), (3,))
    many = spark.range(5000).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("v"))
    got = feed.join_matching_or_alone(trailers, many, "id", "k", "v")
    assert got.groupBy("id").count().orderBy("id").collect() == [(1, 5000), (2, 1), (3, 1)]


def test_photo_count_of_maps_arrays_and_text(frame):
    maps = frame("id bigint, trailername string, photos map<string,string>", (1, "a", {"mainView": "u"}), (2, "b", None), (3, "c", {"a": "1", "b": "2"}))
    assert [(r.id, r.pictures) for r in feed.photo_count(maps).collect()] == [(3, 2), (1, 1), (2, None)]
    arrays = frame("id bigint, trailername string, photos array<string>", (1, "a", ["u"]), (2, "b", None))
    assert column(feed.photo_count(arrays), "pictures") == {1: 1, 2: None}
    text = frame("id bigint, trailername string, photos string", (1, "a", '["u","v"]'), (2, "b", '{"mainView":"u"}'), (3, "c", None))
    assert column(feed.photo_count(text), "pictures") == {1: 2, 2: 1, 3: None}


def test_map_link_is_null_without_a_coordinate(frame):
    df = frame("id bigint, location_name string, trailername string, latitude decimal(6,4), longitude decimal(6,4)",
               (1, "b", "x", "56.95", "24.11"), (2, "a", "x", None, "1"))
    assert column(feed.map_link(df), "map_link") == {1: "https://maps.google.com/?q=56.9500,24.1100", 2: None}


def test_seed_report_is_an_inner_join(frame):
    trailers = frame("id bigint, trailername string, main_category string, location_name string, price_per_hr int, description string",
                     (1, "a", "m", "l", 5, "Start it"), (2, "b", "m", "l", 5, "Start"), (3, "c", "m", "l", 5, "Re Start"), (4, "d", "m", "l", 5, None))
    profiles = frame(PROFILE, (1, 1, "a", None, "EUR", 5, 12, 60, 180), (2, 2, "b", False, "EUR", 5, 12, 60, 180), (3, 3, "b", True, "EUR", 5, 12, 60, 180))
    assert ids(feed.seed_profile_report(trailers, profiles, "Start")) == [1]
