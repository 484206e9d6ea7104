import pytest
from pyspark.sql import functions as F
from tests.conftest import as_dicts, column

from lendlane.operators import feed, listings
from lendlane.sources.golden import golden

NOW = "2026-07-06 00:00:00"
BATCH = "seq bigint, host_id bigint, trailername string, location_name string, model string"


def test_import_skips_known_and_repeated_keys(frame):
    batch = frame(
        BATCH, (1, 1, "a", "Riga", "m"), (2, 1, "a", "Riga", "m"), (3, 1, "b", "Riga", "m"), (4, 1, "a", "Riga", "n"),
        (5, 1, "c", None, "m"), (6, 1, "c", None, "m"),
    )
    existing = frame("id bigint, host_id bigint, trailername string, location_name string, model string",
                     (1, 1, "b", "Riga", "m"), (2, 1, "c", None, "m"), (3, 2, "a", "Riga", "m"))
    # a NULL equals nothing, so rows 5 and 6 both go in
    assert sorted(r.seq for r in listings.listing_import(batch, existing).collect()) == [1, 4, 5, 6]
    assert listings.listing_import(batch.where("seq < 5"), batch).count() == 0


def test_import_of_a_third_of_all_rows_under_one_key(spark, frame):
    batch = spark.range(3000).selectExpr(
        "id as seq", "1L as host_id", "if(id % 3 = 0, 'hot', cast(id as string)) as trailername", "'Riga' as location_name", "'m' as model"
    )
    got = listings.listing_import(batch, batch.where("false"))
    assert got.count() == 2001 and got.where("trailername = 'hot'").first().seq == 0


def test_start_import_looks_at_the_prefix(frame):
    batch = frame("seq bigint, host_id bigint, trailername string", (1, 1, "a"), (2, 1, "b"), (3, 1, "b"))
    existing = frame("host_id bigint, trailername string, description string", (1, "a", "Start x"), (1, "b", "Other"))
    assert [r.seq for r in listings.listing_import_start(batch, existing, "Start").collect()] == [2]


def test_defaults(frame):
    row = listings.listing_defaults(frame("seq bigint, photo string", (1, "u")), NOW).first()
    assert (row.price_per_hr, row.status, row.is_available, row.busy_display) == (5, "active", False, True)
    assert row.photos == {"mainView": "u"} and str(row.starter_expires_at) == "2027-01-02 00:00:00"
    start = listings.start_listing_defaults(frame("seq bigint, photo string", (1, "u")), NOW)
    assert start.first().is_available and "busy_display" not in start.columns


def test_ids_follow_source_order(frame):
    new = frame("seq bigint, host_id bigint", (40, 1), (7, 2), (3_000_000, 3))
    trailers = frame("id bigint", (10,), (99,))
    profiles = frame("id bigint", (500,))
    got = as_dicts(listings.default_profile_for_import(new, trailers, profiles, NOW), "host_id")
    assert [(got[h]["trailer_id"], got[h]["id"]) for h in (2, 1, 3)] == [(100, 501), (101, 502), (102, 503)]
    assert [got[1][c] for c in listings.DEFAULT_PROFILE] == [5, 5, 12, 60, 180]
    empty = listings.default_profile_for_import(new, trailers.where("false"), profiles.where("false"), NOW)
    assert sorted((r.trailer_id, r.id) for r in empty.collect()) == [(1, 1), (2, 2), (3, 3)]


HOSTS = "id bigint, host_uid string, email string, full_name string"


def test_host_resolution_tiers(frame):
    hosts = frame(HOSTS, (5, "e", " Info@X.example ", None), (3, "c", "sales@acme.example", None), (2, "b", None, "Acme Ltd"), (9, "i", "info@x.example", None))
    got = as_dicts(listings.host_resolution(hosts, [
        listings.HostRequest("exact", ("info@x.example",), "acme"),
        listings.HostRequest("part", ("none@x.example",), "acme"),
        listings.HostRequest("none", ("none@x.example",), "zzz"),
    ]), "request")
    assert (got["exact"]["tier"], got["exact"]["host_id"]) == (1, 5)
    assert (got["part"]["tier"], got["part"]["host_uid"]) == (2, "b")
    assert got["none"]["host_id"] is None
    assert got["none"]["error"] == "host not found: id=2 email=- nimi=Acme Ltd; id=3 email=sales@acme.example nimi=-; id=5 email= Info@X.example  nimi=-; id=9 email=info@x.example nimi=-"
    shorter = listings.host_resolution(hosts, [listings.HostRequest("none", (), "zzz")], listed=1).first()
    assert shorter.error == "host not found: id=2 email=- nimi=Acme Ltd; and 3 more"
    sole = listings.host_resolution(hosts.where("id = 9"), [listings.HostRequest("r", ("none@x.example",), "zzz")]).first()
    assert (sole.tier, sole.host_id, sole.error) == (3, 9, None)
    nobody = listings.host_resolution(hosts.where("false"), [listings.HostRequest("r", ("a@x.example",), "a")]).first()
    assert nobody.error == "host not found"


def test_host_list_lines(frame):
    hosts = frame(HOSTS, (12, "", "b@x", ""), (2, "", None, ""), (1, "", "a@x", ""))
    assert [r.host_list for r in listings.host_list_agg(hosts, 10).collect()] == ["id=1 email=a@x; id=2 email=-", "id=12 email=b@x"]
    named = listings.host_list_agg(hosts, 10, listings.NAMED_HOST_FIELDS)
    assert [r.host_list for r in named.collect()] == ["id=1 email=a@x nimi=; id=2 email=- nimi=", "id=12 email=b@x nimi="]


def test_expired(frame):
    trailers = frame("id bigint, model string, starter_expires_at timestamp_ntz", (1, "s", "2026-07-05"), (2, "s", NOW), (3, "s", None), (4, "r", "2020-01-01"))
    profiles = frame("id bigint, trailer_id bigint", (1, 1), (2, 1), (3, 2), (4, 4), (5, None))
    assert sorted(r.id for r in listings.expired_listings(trailers, NOW, "s").collect()) == [1]
    assert sorted(r.id for r in listings.expired_profiles(trailers, profiles, NOW, "s").collect()) == [1, 2]
    assert sorted(r.id for r in listings.without_expired(trailers, NOW, "s").collect()) == [2, 3, 4]
    assert sorted(r.id for r in listings.profiles_without_expired(trailers, profiles, NOW, "s").collect()) == [3, 4, 5]


@pytest.fixture(scope="module")
def seeded(spark):
    """Placeholder listings built by rule: 27 cities x 6, 31 x 6 and 113 x 3, and 3 cities x 20 districts."""
    cities = golden(spark, "city_centres").selectExpr("loc", "clat", "clng", "row_number() over (order by loc) as n")
    waves = cities.selectExpr("loc as location_name", "n", "explode(sequence(1, if(n <= 58, 6, 3))) as k")
    districts = spark.range(60).selectExpr(
        "concat('District ', id % 20, ', ', element_at(array('Rīga', 'Helsinki', 'Tampere'), int(id / 20) + 1)) as location_name",
        "1000 + id as n", "1 as k")
    rows = waves.unionByName(districts).selectExpr(
        "n * 10 + k as seq", "7L as host_id", "concat('trailer ', k) as trailername", "'Placeholder' as model", "location_name",
        "cast(0 as decimal(10,6)) as latitude", "cast(0 as decimal(10,6)) as longitude", "'u' as photo")
    return listings.listing_defaults(rows, NOW)


def test_seed_counts(spark, frame, seeded):
    new = listings.listing_import(seeded, frame("id bigint, host_id bigint, trailername string, location_name string, model string"))
    loaded = listings.assign_ids(new, spark.range(0))
    assert loaded.count() == 747
    profiles = listings.default_profile_for_import(new, spark.range(0), spark.range(0), NOW)
    bookings = frame("id bigint, trailer_id bigint, status string, start_at timestamp_ntz, end_at timestamp_ntz")
    waves = loaded.where("not location_name like '%, %'")
    shown = feed.public_feed_current(waves, profiles, bookings, NOW)
    assert as_dicts(feed.busy_share(shown)) == [{"busy": 687, "total": 687}]
    two_waves = feed.public_feed_current(waves.where("seq < 590"), profiles, bookings, NOW)
    assert feed.busy_share(two_waves).first().busy == 348
    density = listings.listings_per_split_city(loaded, ["Rīga", "Helsinki", "Tampere"])
    assert [(r.city, r.listings) for r in density.collect()] == [("Helsinki", 20), ("Rīga", 20), ("Tampere", 20)]
    per_city = listings.listings_per_city(loaded, "Placeholder")
    assert per_city.count() == 171 + 60


def test_relocation_moves_known_cities_only(spark, seeded):
    loaded = listings.assign_ids(seeded, spark.range(0))
    centres, offsets = golden(spark, "city_centres"), golden(spark, "city_offsets")
    moved = listings.relocate_listings(loaded, centres, offsets, "2026-08-01", "Placeholder")
    assert moved.where("latitude <> 0").count() == 687 and moved.count() == 747
    aarhus = moved.where("location_name = 'Aarhus'").orderBy("id").collect()
    assert [float(r.latitude) for r in aarhus] == [56.1689, 56.1589, 56.1709, 56.1569, 56.1729, 56.1659]
    assert moved.where("updated_at = '2026-08-01'").count() == 687


def test_slots_wrap_round(frame):
    df = frame("id bigint, location_name string", *[(i, "A") for i in range(10, 24)], (1, None), (2, None))
    got = column(listings.slot_in_city(df), "slot")
    assert [got[i] for i in range(10, 24)] == [0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 0, 1] and (got[1], got[2]) == (0, 1)


def test_district_match(frame):
    df = frame("id bigint, location_name string", (1, "Pirita, Tallinn"), (2, "Tallinn"), (3, "x, Tallinna"), (4, None), (5, "y, Riga"))
    assert sorted(r.id for r in listings.like_any_district(df, ["Tallinn", "Riga"]).collect()) == [1, 5]
    assert {r.city: r.listings for r in listings.listings_per_split_city(df).collect()} == {"Tallinn": 1, "": 1, "Tallinna": 1, None: 1, "Riga": 1}
    assert feed.listing_status_filter(df.withColumn("status", F.lit("Active"))).count() == 5
