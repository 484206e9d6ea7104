from tests.conftest import as_dicts, column

from lendlane.operators import admission

NOW = "2026-07-06 00:00:00"
CONFIG = (
    "country_code string, currency string, country_status string, market_status string, booking_enabled boolean,"
    " payments_enabled boolean, payouts_enabled boolean, stripe_supported boolean"
)


def world(frame):
    trailers = frame("id bigint, busy_display boolean, is_available boolean", (1, True, False), (2, True, True), (3, None, None), (4, True, None))
    hosts = frame("id bigint, host_uid string, country_code string", (1, "ee", "ee"), (2, "dd", "DD"), (3, "none", None), (4, "blank", ""), (5, "xx", "XX"), (9, "ee", "DD"))
    config = frame(CONFIG, ("EE", "eur", "ACTIVE", "live", True, True, True, True), ("DD", "eur", "DISABLED", "blocked", False, True, True, True))
    requests = frame(
        "id bigint, trailer_id bigint, host_uid string",
        (1, 1, "dd"), (2, 2, "ee"), (3, 3, "dd"), (4, 99, "none"), (5, None, "blank"), (6, 4, "xx"), (7, 2, "xx"), (8, 2, "unknown host"), (9, 2, None),
    )
    return requests, trailers, hosts, config


def test_first_failing_rule_gives_the_reason(frame):
    opened = as_dicts(admission.booking_admission(*world(frame), "open"), "id")
    assert [opened[i]["reason"] for i in range(1, 10)] == [
        "busy_listing", "ok", "country_blocked (DD)", "ok", "ok", "busy_listing", "ok", "ok", "ok"]
    denied = as_dicts(admission.booking_admission(*world(frame), "deny"), "id")
    assert [denied[i]["reason"] for i in range(1, 10)] == [
        "busy_listing", "ok", "country_blocked (DD)", "country_blocked (unknown)", "country_blocked (unknown)",
        "busy_listing", "country_blocked (XX)", "country_blocked (unknown)", "country_blocked (unknown)"]
    assert all(denied[i]["accepted"] == (denied[i]["reason"] == "ok") for i in denied)


def test_unpaid_bookings_on_busy_listings(frame):
    _, trailers, _, _ = world(frame)
    bookings = frame("id bigint, trailer_id bigint, payment_status string", (1, 1, None), (2, 1, "paid"), (3, 1, "pending"), (4, 2, None), (5, 99, None), (6, None, None), (7, 4, "PAID"))
    gone = admission.unpaid_busy_bookings(bookings, trailers)
    kept = admission.unpaid_busy_bookings(bookings, trailers, keep=True)
    assert sorted(r.id for r in gone.collect()) == [1, 3, 7]
    assert sorted(r.id for r in kept.collect()) == [2, 4, 5, 6]


def test_checkout_ladder(frame):
    bookings = frame(
        "id bigint, currency string, payment_status string, total_price decimal(16,5)",
        (1, "eur", None, "10"), (2, "SEK", "paid", "10"), (3, None, "paid", "10"), (4, "EUR", "pending", "0.49"),
        (5, "EUR", None, "10000"), (6, "EUR", None, "10000.01"), (7, "EUR", None, None), (8, "EUR", "Paid", "0.495"), (9, "", None, "10"),
    )
    requests = frame("event_id bigint, booking_id string", *[(i, str(i)) for i in range(1, 10)],
                     (20, "77"), (21, "0"), (22, "x"), (23, None), (24, " 1.0 "), (25, "1.5"), (26, ""))
    got = as_dicts(admission.checkout_audit(requests, bookings), "event_id")
    assert {i: got[i]["outcome"] for i in got} == {
        1: "ok", 2: "non_eur", 3: "already_paid", 4: "bad_amount", 5: "ok", 6: "bad_amount", 7: "bad_amount", 8: "ok", 9: "non_eur",
        20: "not_found", 21: "bad_id", 22: "bad_id", 23: "bad_id", 24: "ok", 25: "bad_id", 26: "bad_id"}
    assert (got[1]["amount_cents"], got[5]["amount_cents"], got[8]["amount_cents"], got[2]["amount_cents"]) == (1000, 1_000_000, 50, None)


def test_line_item(frame):
    df = frame("id bigint, trailer_id bigint, trailer_type string", (1, 7, "Box"), (2, 7, ""), (3, None, None))
    assert column(admission.checkout_line_item(df, "Acme"), "line_item") == {
        1: "Acme rent — Box #7", 2: "Acme rent — trailer #7", 3: "Acme rent — trailer #3"}


def test_authorize(frame):
    df = frame("event_id bigint, currency string, amount string", (1, None, "50"), (2, "EUR", "1000000"), (3, "eur", "49"), (4, "", "100"),
               (5, "usd", "x"), (6, "eur", "100.5"), (7, "eur", None), (8, "eur", "1e3"), (9, "eur", "1000001"))
    got = as_dicts(admission.authorize_audit(df), "event_id")
    assert [got[i]["outcome"] for i in range(1, 10)] == ["ok", "ok", "bad_amount", "non_eur", "non_eur", "bad_amount", "bad_amount", "ok", "bad_amount"]
    assert got[8]["amount_cents"] == 1000


def test_cancel_fee(frame):
    got = as_dicts(admission.cancel_fee_audit(frame("event_id int, penalty_amount int", (1, None), (2, 0), (3, -1), (4, 7))), "event_id")
    assert [(got[i]["outcome"], got[i]["captured_amount"]) for i in (1, 2, 3, 4)] == [("rejected", None)] * 3 + [("captured", 7)]


def test_session_link_takes_the_last_session(frame):
    bookings = frame("id bigint, stripe_checkout_session_id string", (1, "old"), (2, "old"), (3, None))
    sessions = frame("booking_id bigint, session_id string, created_seq int", (1, "b", 1), (1, "a", 2), (9, "z", 1))
    got = as_dicts(admission.session_link(bookings, sessions, NOW), "id")
    assert [got[i]["stripe_checkout_session_id"] for i in (1, 2, 3)] == ["a", "old", None]
    assert got[1]["updated_at"] is not None and got[2]["updated_at"] is None
