from decimal import Decimal

from tests.conftest import as_dicts, column

from lendlane.operators import onboarding, payouts, reports
from lendlane.plans import jobs
from lendlane.sources.golden import golden

NOW = "2026-07-06 00:00:00"
BOOKING = (
    "id bigint, host_uid string, status string, payout_status string, payout_due_at timestamp_ntz,"
    " host_payout_amount decimal(16,5), currency string, total_price decimal(16,5)"
)
HOST = "id bigint, host_uid string, full_name string, country_code string, stripe_account_id string, payouts_enabled boolean"
CONFIG = (
    "country_code string, currency string, country_status string, market_status string, booking_enabled boolean, payments_enabled boolean,"
    " payouts_enabled boolean, stripe_supported boolean, host_enabled boolean, stripe_connect_supported boolean"
)


def config(frame):
    return frame(
        CONFIG, ("EE", "EUR", "ACTIVE", "live", True, True, True, True, True, True), ("SE", "sek", "ACTIVE", "live", True, True, False, True, True, True),
        ("NG", "ngn", "ACTIVE", "live", True, True, True, True, True, False), ("DD", "eur", "DISABLED", "blocked", True, True, True, True, True, True),
        ("NO", "nok", "ACTIVE", "live", True, True, None, True, False, True),
    )


def hosts(frame):
    return frame(
        HOST, (1, "ee", "A B", "ee", "acct_1", None), (2, "se", None, "SE", "acct_2", True), (3, "none", "", None, "acct_3", False),
        (4, "blank", "C", "EE", "", True), (5, "twice", "D", "EE", "acct_5", True), (6, "twice", "D", "EE", "acct_6", True),
        (7, "space", "E", " EE ", "acct_7", True), (8, "dd", "F", "DD", "acct_8", True), (9, "no", "G", "NO", "acct_9", True),
    )


def booking(id, host="ee", status="completed", payout="pending", due=NOW, amount="10", currency="EUR", total=20):
    return (id, host, status, payout, due, amount, currency, total)


def test_due_is_exact_and_inclusive(frame):
    df = frame(BOOKING, booking(1), booking(2, due="2026-07-06 00:00:01"), booking(3, status="Completed"), booking(4, payout=None), booking(5, due=None))
    assert [r.id for r in payouts.payout_due(df, NOW).collect()] == [1]


def test_plan_ladder(frame):
    df = frame(
        BOOKING, booking(1), booking(2, "se"), booking(3, "none", currency="SEK"), booking(4, "blank"), booking(5, "twice"),
        booking(6, "space", currency=None), booking(7, "dd"), booking(8, payout="paid", amount=0), booking(9, amount=None),
        booking(10, amount="0.00499"), booking(11, "missing"), booking(12, None), booking(13, "no"), booking(14, amount="0.005"), booking(15, payout="failed"),
    )
    got = as_dicts(payouts.payout_plan(df, hosts(frame), config(frame)), "booking_id")
    assert {i: got[i]["outcome"] for i in got} == {
        1: "transfer", 2: "country_blocked", 3: "transfer", 4: "no_account", 5: "no_account", 6: "transfer", 7: "country_blocked",
        8: "already_paid", 9: "no_amount", 10: "no_amount", 11: "no_account", 12: "no_account", 13: "transfer", 14: "transfer", 15: "transfer"}
    # configured currency, else the booking's, else euro; ' EE ' is looked up untrimmed
    assert [got[i]["transfer_currency"] for i in (1, 3, 6, 13, 2)] == ["eur", "sek", "eur", "nok", None]
    assert (got[14]["amount_cents"], got[2]["blocked_country"], got[1]["destination"]) == (1, "SE", "acct_1")
    manual = payouts.payout_plan_manual(df, frame("booking_id bigint", (15,), (8,), (99,)), hosts(frame), config(frame))
    assert column(manual, "outcome", "booking_id") == {15: "transfer", 8: "already_paid"}
    summary = as_dicts(payouts.payout_run_summary(payouts.payout_plan(df, hosts(frame), config(frame))), "outcome")
    assert summary["processed"]["bookings"] == 15 and summary["transfer"]["bookings"] == 6


def test_settle_and_ledger(frame):
    df = frame(BOOKING, booking(1), booking(2), booking(3), booking(4))
    results = frame("booking_id bigint, ok boolean, transfer_id string", (1, True, "tr_1"), (2, False, None), (4, True, "tr_4"), (4, False, None), (99, True, "tr_99"))
    run = jobs.payout_run(df, hosts(frame), config(frame), results, frame("booking_id bigint", (4,)), NOW)
    settled = as_dicts(run.bookings, "id")
    assert [(settled[i]["payout_status"], settled[i]["payout_transfer_id"]) for i in (1, 2, 3, 4)] == [
        ("paid", "tr_1"), ("failed", None), ("pending", None), ("paid", "tr_4")]
    rows = as_dicts(run.ledger_rows, "booking_id")
    assert set(rows) == {1} and rows[1]["amount"] == Decimal(10) and rows[1]["transfer_id"] == "tr_1"
    assert run.plan.count() == 4


def test_ledger_append_twice_writes_once(spark, frame, tmp_path):
    df = frame(BOOKING, booking(1), booking(2))
    results = frame("booking_id bigint, ok boolean, transfer_id string", (1, True, "tr_1"), (2, True, "tr_2"))
    path = str(tmp_path / "ledger")
    payouts.write_ledger(payouts.payout_ledger_append(df, results.where("booking_id = 1"), None, NOW), path)
    for _ in range(2):
        payouts.write_ledger(payouts.payout_ledger_append(df, results, spark.read.parquet(path), NOW), path)
    assert sorted(r.booking_id for r in spark.read.parquet(path).collect()) == [1, 2]


REQUEST = "request_id bigint, host_uid string, country string, full_name string"


def test_eligibility_ladder_and_backfill(frame):
    requests = frame(
        REQUEST, (1, None, "EE", None), (2, "", "EE", None), (3, "missing", "EE", None), (4, "twice", "EE", None), (5, "none", None, None),
        (6, "ee", "", None), (7, "ee", " \tse\n", None), (8, "ee", "ng", None), (9, "ee", "DD", None), (10, "ee", "NO", None),
        (11, "space", None, None), (12, "none", "zz", None), (13, "none", "ee", None),
    )
    eligible = onboarding.onboarding_eligibility(requests, hosts(frame), config(frame))
    got = as_dicts(eligible, "request_id")
    assert [got[i]["outcome"] for i in range(1, 14)] == [
        "no_host_uid", "no_host_uid", "host_not_found", "host_not_found", "no_country", "no_country", "eligible",
        "blocked", "blocked", "blocked", "eligible", "eligible", "eligible"]
    assert (got[7]["onboarding_country"], got[11]["onboarding_country"], got[6]["onboarding_country"]) == ("SE", "EE", None)
    filled = column(onboarding.onboarding_country_backfill(hosts(frame), eligible), "country_code")
    assert filled[3] == "ZZ" and filled[1] == "ee" and filled[7] == " EE "


def test_names(frame):
    df = frame("id int, full_name string", (1, " Mari  Maasikas Tamm "), (2, "Mari"), (3, ""), (4, None), (5, "a b"))
    got = as_dicts(onboarding.host_name_split(df), "id")
    assert [(got[i]["first_name"], got[i]["last_name"]) for i in range(1, 6)] == [
        ("Mari", " Maasikas Tamm"), ("Mari", None), (None, None), (None, None), ("a", "b")]


def test_accounts_are_opened_once_per_host_with_contacts_that_fall_back(frame):
    asked = frame(
        "request_id bigint, host_uid string, onboarding_country string, outcome string, full_name string, email string, phone string",
        (1, "a", "EE", "blocked", "Not Me", None, None), (3, "a", "EE", "eligible", None, " a@x ", None), (2, "a", "FI", "eligible", "", "  ", " "),
        (4, "b", "EE", "eligible", None, None, None), (5, "c", "EE", "eligible", "Has One", None, None), (6, None, None, "no_host_uid", None, None, None))
    hosts = frame(HOST + ", phone_number string", (1, "a", "Own Name", None, "", None, "+372 1"), (2, "b", " Own Name Too ", None, None, None, " +372 2 "),
                  (3, "c", "C", None, "acct_c", None, None), (4, None, "nobody", None, None, None, None))
    rows = onboarding.account_requests(asked, hosts)
    assert as_dicts(rows, "host_uid") == {
        "a": {"host_uid": "a", "request_id": 2, "country": "FI", "email": None, "phone": None, "first_name": None, "last_name": None},
        "b": {"host_uid": "b", "request_id": 4, "country": "EE", "email": None, "phone": "+372 2", "first_name": "Own", "last_name": "Name Too"}}
    opened = frame("host_uid string, account_id string", ("a", "acct_1"), ("b", "acct_2"), ("c", "never"))
    linked = onboarding.link_accounts(hosts, opened)
    assert column(linked, "stripe_account_id") == {1: "acct_1", 2: "acct_2", 3: "acct_c", 4: None}
    # once linked, no host asks again; requests without contact columns use the hosts' own
    assert onboarding.account_requests(asked, linked).isEmpty()
    bare = onboarding.account_requests(asked.select("request_id", "host_uid", "onboarding_country", "outcome"), hosts)
    assert column(bare, "first_name", "host_uid") == {"a": "Own", "b": "Own"}


def test_state(frame):
    accounts = frame(
        "host_id bigint, payouts_enabled boolean, details_submitted boolean, currently_due array<string>, past_due array<string>",
        (1, True, False, ["x"], None), (2, None, True, [], []), (3, False, True, ["x"], []), (4, False, True, None, ["y"]), (5, None, None, None, None))
    states = onboarding.onboarding_state(accounts)
    assert column(states, "state", "host_id") == {1: "done", 2: "done", 3: "link_needed", 4: "link_needed", 5: "link_needed"}
    flags = column(onboarding.hosts_with_payout_flag(hosts(frame), states), "payouts_enabled")
    assert (flags[1], flags[2], flags[5], flags[9]) == (True, False, False, True)


def test_requests_of_a_host_see_each_other(frame):
    """Against a fold, one request at a time."""
    import random
    dice, rows = random.Random(3), []
    for i in range(200):
        rows.append((i, dice.choice(["none", "blank", "ee", "missing"]), dice.choice([None, None, "", "EE", "DD", " se ", "NO"]), None))
    all_hosts = [(5, "none", None, None, None, None), (6, "blank", None, "", None, None), (7, "ee", None, "ee", None, None)]
    own = frame(HOST, *all_hosts)
    alone = as_dicts(onboarding.onboarding_eligibility(frame(REQUEST, (0, "ee", "EE", None), (1, "ee", "DD", None), (2, "ee", "SE", None), (3, "ee", "NO", None)), own, config(frame)))
    verdict = {r["onboarding_country"]: r["outcome"] for r in alone}
    stored, expected = {h[1]: h[3] for h in all_hosts}, {}
    for i, host, country, _ in rows:
        asked = (country if country is not None else stored.get(host) or "").strip().upper()
        expected[i] = "host_not_found" if host == "missing" else "no_country" if not asked else verdict[asked]
        if expected[i] == "eligible" and not stored[host]:
            stored[host] = asked
    got = onboarding.onboarding_eligibility(frame(REQUEST, *rows), own, config(frame))
    assert column(got, "outcome", "request_id") == expected


def test_tiers(spark, frame):
    markets = golden(spark, "country_markets")
    some_hosts = frame(HOST, (1, "a", None, "ee", None, None), (2, "b", None, "US", None, None), (3, "c", None, "ng", None, None), (4, "d", None, "XX", None, None), (5, "e", None, None, None, None))
    bookings = frame(BOOKING, booking(1, "a", total=5), booking(2, "a", total=7), booking(3, "d", total=1), booking(4, "ghost", total=100))
    got = as_dicts(reports.market_tier_rollup(markets, some_hosts, bookings), "tier")
    assert {t: r["countries"] for t, r in got.items()} == {"euro_auto_payout": 21, "live_non_euro": 23, "manual_payout": 7, "unlisted": 0}
    assert {t: (r["hosts"], r["bookings"], int(r["booking_value"])) for t, r in got.items()} == {
        "euro_auto_payout": (1, 2, 12), "live_non_euro": (1, 0, 0), "manual_payout": (1, 0, 0), "unlisted": (2, 2, 101)}


def test_held_balance(frame):
    df = frame(BOOKING, booking(1), booking(2, payout=None, amount="2.5"), booking(3, payout="paid"), booking(4, status="requested"), booking(5, "twice", amount=None))
    got = as_dicts(reports.held_host_balance(df, hosts(frame)), "host_uid")
    assert (got["ee"]["held_amount"], got["ee"]["country_code"], got["ee"]["bookings"]) == (Decimal("12.5"), "ee", 2)
    assert (got["twice"]["country_code"], got["twice"]["held_amount"]) == (None, 0)
    assert len(got) == 2
