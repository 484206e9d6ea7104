import pytest

from lendlane.operators.listings import HostRequest
from lendlane.plans import listing_load
from lendlane.plans.listing_load import ListingStore, load_listings, start_listings
from lendlane.sources import store as stores
from tests.conftest import as_dicts, column

AS_OF = "2026-07-06 12:00:00"
WHO = HostRequest("r", ("a@x.example",), "nobody")
ROWS = "seq long, trailername string, model string, location_name string, photo string, description string"


@pytest.fixture
def hosts(frame):
    return frame("id long, host_uid string, email string, full_name string", (7, "u7", "b@x.example", "B"), (9, "u9", " A@X.example ", None))


@pytest.fixture
def started(frame, tmp_path):
    store = ListingStore(str(tmp_path / "store"))
    store.create(
        frame("id long, host_id long, trailername string, model string, location_name string, description string",
              (40, 9, "known", "m", "L", "Start one"), (3, 9, "other", "m", "L", "x"), (4, 7, "new", "m", "L", "Start two")),
        frame("id long, trailer_id long, name string", (900, 3, "p")))
    return store


def tables(spark, store):
    return [sorted(map(str, as_dicts(store.read(spark, t)))) for t in listing_load.TABLES]


def rows(frame, *given):
    return frame(ROWS, *[(n, *r, "http://p", None) for n, r in given])


def test_a_load_adds_listings_and_profiles(spark, frame, hosts, started):
    batch = rows(frame, (5, ("known", "m", "L")), (2, ("new", "m", "L")), (9, ("new", "m", "L")), (7, ("free", "m", None)), (8, ("free", "m", None)))
    assert load_listings(started, batch, hosts, WHO, AS_OF, "one")
    new = as_dicts(started.read(spark, "trailers").where("load = 'one'"), "id")
    assert {i: r["trailername"] for i, r in new.items()} == {41: "new", 42: "free", 43: "free"}
    assert {(r["host_id"], r["host_uid"], r["is_available"], str(r["price_per_hr"])) for r in new.values()} == {(9, "u9", False, "5.00")}
    assert new[41]["photos"] == {"mainView": "http://p"}
    profiles = as_dicts(started.read(spark, "pricing_profiles").where("load = 'one'"), "id")
    assert {i: (r["trailer_id"], r["host_id"], r["name"], str(r["daily_rate"])) for i, r in profiles.items()} == {
        901: (41, 9, "Default", "12.00"), 902: (42, 9, "Default", "12.00"), 903: (43, 9, "Default", "12.00")}


def test_the_same_load_twice_is_one(spark, frame, hosts, started):
    batch = rows(frame, (1, ("new", "m", "L")), (2, ("free", "m", None)))
    assert load_listings(started, batch, hosts, WHO, AS_OF, "one")
    before = tables(spark, started)
    assert not load_listings(started, batch, hosts, WHO, AS_OF, "one")
    assert tables(spark, started) == before
    # under another name only the row without a place is new: NULL equals nothing
    assert load_listings(started, batch, hosts, WHO, AS_OF, "two")
    assert column(started.read(spark, "trailers").where("load = 'two'"), "trailername") == {43: "free"}


@pytest.mark.parametrize("broken, next_load", [(3, False), (5, False), (6, True)])
def test_a_load_that_dies_is_finished_once(spark, frame, hosts, tmp_path, monkeypatch, broken, next_load):
    """Dies before its reservation, between the two tables, or before its end; the next run, or the next load, finishes it."""
    store = ListingStore(str(tmp_path / "store"))
    store.create(frame("id long, host_id long, trailername string", (40, 9, "known")), frame("id long, trailer_id long", (900, 3)))
    before, calls = tables(spark, store), []

    def dying(function):
        def run(*args, **values):
            calls.append(function.__name__)
            if len(calls) == broken:
                raise RuntimeError("lost")
            return function(*args, **values)
        return run

    batch = rows(frame, (1, ("new", "m", "L")), (2, ("free", "m", None)))
    with monkeypatch.context() as m:
        m.setattr(listing_load, "replace", dying(stores.replace))
        m.setattr(stores.Journal, "note", dying(stores.Journal.note))
        with pytest.raises(RuntimeError):
            load_listings(store, batch, hosts, WHO, AS_OF, "one")
    assert calls == ["replace", "replace", "note", "replace", "replace", "note"][:broken]
    assert tables(spark, store) == before  # readers see neither table's rows
    if next_load:
        load_listings(store, rows(frame), hosts, WHO, AS_OF, "two")
    else:
        load_listings(store, batch, hosts, WHO, AS_OF, "one")
    assert column(store.read(spark, "trailers"), "trailername") == {40: "known", 41: "new", 42: "free"}
    assert column(store.read(spark, "pricing_profiles"), "trailer_id") == {900: 3, 901: 41, 902: 42}


def test_start_loads_know_listings_by_prefix(spark, frame, hosts, started):
    batch = rows(frame, (1, ("known", "m2", "Elsewhere")), (2, ("other", "m", "L")))
    load_listings(started, batch, hosts, WHO, AS_OF, "one", start_listings("Start"))
    new = as_dicts(started.read(spark, "trailers").where("load = 'one'"))
    assert [(r["id"], r["trailername"], r["is_available"], r["busy_display"], r["starter_expires_at"]) for r in new] == [(41, "other", True, None, None)]


def test_without_a_host_the_error_lists_them(frame, hosts, started):
    with pytest.raises(LookupError) as error:
        load_listings(started, rows(frame, (1, ("new", "m", "L"))), hosts, HostRequest("r", (), "nobody"), AS_OF, "one")
    assert str(error.value) == "host not found: id=7 email=b@x.example nimi=B; id=9 email= A@X.example  nimi=-"


def test_an_empty_load_is_done(spark, frame, hosts, started):
    before = tables(spark, started)
    assert load_listings(started, rows(frame), hosts, WHO, AS_OF, "none")
    assert tables(spark, started) == before and not load_listings(started, rows(frame), hosts, WHO, AS_OF, "none")


def test_names_stay_inside_the_folder():
    for name in ("", "a/b", "..", "a b", "x=1"):
        with pytest.raises(ValueError):
            stores.checked_name(name)


def test_partitions_of_unfinished_loads_are_not_read(spark, frame, hosts, started):
    load_listings(started, rows(frame, (1, ("new", "m", "L"))), hosts, WHO, AS_OF, "one")
    plan = started.read(spark, "trailers")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_shared_folder_comes_from_the_session(spark):
    assert stores.new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
