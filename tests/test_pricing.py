import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tests.conftest import as_dicts, column

from lendlane.operators import pricing
from lendlane.plans import jobs

NOW = "2026-07-06 00:00:00"
PROFILE = (
    "id bigint, trailer_id bigint, host_id bigint, name string, is_active boolean, currency string,"
    " hourly_rate decimal(10,2), short_rental_price decimal(10,2), daily_rate decimal(10,2),"
    " weekly_rate decimal(10,2), monthly_rate decimal(10,2), updated_at timestamp_ntz"
)
RATES = ["hourly_rate", "short_rental_price", "daily_rate", "weekly_rate", "monthly_rate"]


def profile(id, trailer, active=True, short=None, name="P", currency="EUR", updated="2020-01-01", **rates):
    r = {"short_rental_price": short, **rates}
    return (id, trailer, 1, name, active, currency, *[r.get(c) for c in RATES], updated)


def random_profiles(seed, n=120, listings=6):
    rng = random.Random(seed)
    price = lambda: rng.choice([None, 0, 0, 0, 3, 7, 20, 200])
    rows = []
    for i in range(1, n + 1):
        empty = rng.random() < 0.6
        rows.append(profile(
            i, rng.choice([None, *range(listings), 0, 0]), rng.choice([True, False, None]),
            name=rng.choice(["Default", "P", None]), currency=rng.choice(["EUR", "eur", None, "USD"]),
            updated=rng.choice([None, "2020-01-01", "2021-06-01 12:00:00.5"]),
            short=None if empty else price(), **({} if empty else {c: price() for c in RATES if c != "short_rental_price"}),
        ))
    return rows


def fold(rows):
    """The insert rule, one row at a time."""
    stored = {}
    for row in rows:
        id, trailer, active, rates = row[0], row[1], row[4], row[6:11]
        if trailer is not None:
            siblings = [k for k, (t, a) in stored.items() if t == trailer and a in (True, None)]
            if any((r or 0) > 0 for r in rates):
                for k in siblings:
                    stored[k] = (trailer, False)
                active = True
            elif siblings:
                active = False
        stored[id] = (trailer, active)
    return {k: a for k, (_, a) in stored.items()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_the_row_by_row_rule(frame, seed):
    rows = random_profiles(seed)
    assert column(pricing.one_active_fold(frame(PROFILE, *rows)), "is_active") == fold(rows)


def test_fold_touches_only_what_a_later_row_switched_off(frame):
    rows = [profile(1, 1, short=5), profile(2, 1), profile(3, 1, short=6), profile(4, 2), profile(5, 2)]
    got = column(pricing.one_active_fold(frame(PROFILE, *rows), NOW), "updated_at")
    assert [str(got[i])[:4] for i in range(1, 6)] == ["2026", "2020", "2020", "2020", "2020"]


def rank_key(row):
    id, name, updated = row[0], row[3], row[11]
    short, daily, weekly, monthly = row[7:11]
    complete = all((v or 0) > 0 for v in (short, daily, weekly, monthly))
    return (not complete, 0 if name is None else 1 if name == "Default" else 2, updated is None,
            -(int(updated[:10].replace("-", "")) if updated else 0), -id)


@pytest.mark.parametrize("seed", range(3))
def test_rank_equals_a_sort(frame, seed):
    rows = [r for r in random_profiles(seed, 150, 4)]
    expected = {}
    for t in range(4):
        mine = sorted((r for r in rows if r[1] == t and r[4] in (True, None)), key=rank_key)
        expected.update({r[0]: n + 1 for n, r in enumerate(mine)})
    assert column(pricing.profile_rank(frame(PROFILE, *rows)), "rn") == expected


def test_dedupe_keeps_the_first_ranked(frame):
    rows = random_profiles(11)
    df = frame(PROFILE, *rows)
    winners = {r.id for r in pricing.profile_rank(df).where("rn = 1").collect()}
    got = as_dicts(pricing.deactivate_duplicates(df, NOW), "id")
    for r in rows:
        loser = r[1] is not None and r[4] in (True, None) and r[0] not in winners
        assert got[r[0]]["is_active"] == (False if loser else r[4])
        assert (str(got[r[0]]["updated_at"]) == NOW) == loser
    assert pricing.double_active_audit(pricing.deactivate_duplicates(df, NOW)).count() == 0


def test_floor_raises_only_positive_euro_prices(frame):
    df = frame(
        PROFILE,
        profile(1, 1, short="4.99", hourly_rate=1, daily_rate="11.5", weekly_rate=59, monthly_rate=179),
        profile(2, 1, short=0, daily_rate=None, weekly_rate=60),
        profile(3, 1, short=1, currency="USD"),
        profile(4, None, short=1),
        profile(5, 1, short=1, currency=None),
        profile(6, 1, short=-3),
    )
    got = as_dicts(pricing.price_floor(df, NOW), "id")
    assert [got[1][c] for c in RATES] == [5, 5, 12, 60, 180]
    assert got[2]["short_rental_price"] == 0 and got[2]["daily_rate"] is None
    assert [got[i]["short_rental_price"] for i in (3, 4, 5, 6)] == [1, 1, 5, -3]
    assert [str(got[i]["updated_at"])[:4] for i in range(1, 7)] == ["2026", "2020", "2020", "2020", "2026", "2020"]


def test_subfloor_audit_ignores_the_hourly_rate(frame):
    df = frame(
        PROFILE, profile(1, 1, short=9, hourly_rate=1), profile(2, 1, short=1), profile(3, 1, active=False, short=1),
        profile(4, 1, active=None, short=9, monthly_rate=100), profile(5, 1, currency="usd", short=1),
    )
    assert {r.id for r in pricing.subfloor_audit(df).collect()} == {2, 4}
    assert pricing.subfloor_audit(pricing.price_floor(df)).count() == 0


TRAILER = "id bigint, host_id bigint, currency string, price_per_hr decimal(10,2)"


def test_orphans_have_no_profile_at_all(frame):
    trailers = frame(TRAILER, (1, 9, None, None), (2, 9, "SEK", 8), (3, 9, "EUR", 8), (4, None, "EUR", 8))
    got = as_dicts(pricing.orphan_profiles(trailers, frame(PROFILE, profile(1, 3, active=False)), NOW), "trailer_id")
    assert set(got) == {1, 2}
    assert (got[1]["currency"], got[1]["hourly_rate"], got[1]["short_rental_price"]) == ("EUR", 0, 0)
    assert (got[2]["currency"], got[2]["hourly_rate"], got[2]["daily_rate"]) == ("SEK", 8, 0)


def test_sync_uses_the_best_profile_with_a_price(frame):
    trailers = frame(TRAILER, (1, 9, "EUR", 1), (2, 9, "EUR", 2), (3, 9, "EUR", 3), (4, 9, "EUR", None))
    profiles = frame(
        PROFILE, profile(1, 1, short=6), profile(2, 1, short=7, name="Default"), profile(3, 2, short=0),
        profile(4, 3, active=False, short=9), profile(5, 4, active=None, short=9),
    )
    assert column(pricing.price_sync(trailers, profiles), "price_per_hr") == {1: 7, 2: 2, 3: 3, 4: 9}


def test_reconcile_is_idempotent_and_leaves_nothing_to_repair(frame):
    trailers = frame(TRAILER, *[(i, 9, "EUR", i) for i in range(9)])
    once = jobs.reconcile_prices(trailers, frame(PROFILE, *random_profiles(5)), NOW)
    assert pricing.double_active_audit(once.profiles).count() == 0
    assert pricing.subfloor_audit(once.profiles).count() == 0
    numbered = once.profiles.withColumn("id", F.coalesce("id", F.col("trailer_id") + 1000))
    twice = jobs.reconcile_prices(once.trailers, numbered, "2027-01-01")
    assert twice.profiles.exceptAll(numbered).count() == 0
    assert twice.trailers.exceptAll(once.trailers).count() == 0


def test_insert_pipeline_floors_first(frame):
    rows = [profile(1, 1, short=1), profile(2, 1, short=None)]
    got = as_dicts(jobs.profile_insert_pipeline(frame(PROFILE, *rows)), "id")
    assert (got[1]["short_rental_price"], got[1]["is_active"], got[2]["is_active"]) == (Decimal(5), True, False)
