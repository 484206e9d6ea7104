import json
import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import as_dicts, column

from lendlane.operators import payments
from lendlane.plans import jobs
from lendlane.streaming import payments as stream
from lendlane.streaming.state import BookingState

NOW = "2026-07-06 00:00:00"
DONE, LATER, FAILED = (
    "checkout.session.completed", "checkout.session.async_payment_succeeded", "checkout.session.async_payment_failed")
EVENT = "event_id bigint, ts timestamp_ntz, type string, booking_id string, payment_status string, session_id string, payment_intent string"
BOOKING = "id bigint, status string, payment_status string, stripe_checkout_session_id string, total_price decimal(16,5), currency string"


def random_world(seed, n=250):
    rng = random.Random(seed)
    bookings = [
        (i, "requested", rng.choice([None, "pending", "paid"]), rng.choice([None, "", "s1", "s2"]), i, "eur") for i in range(1, 25)
    ]
    events = []
    for i in range(n):
        booking = "3" if rng.random() < 0.4 else rng.choice([*map(str, range(1, 30)), None, "x", "7.0", " 8"])
        events.append((
            i, f"2026-01-01 00:{rng.randrange(60):02d}:00", rng.choice([DONE, DONE, DONE, LATER, FAILED, "other", None]), booking,
            rng.choice(["paid", "paid", "paid", "unpaid", None]), rng.choice(["s1", "s1", "s2", "s3", ""]), f"pi_{i}",
        ))
    return bookings, events


def judge(bookings, events):
    """The handler, one event at a time."""
    state = {b[0]: {"paid": b[2] == "paid", "session": b[3]} for b in bookings}
    outcome = {}
    for id, _, type, booking, paid, session, _ in events:
        try:
            number = float(booking)
        except (TypeError, ValueError):
            number = 0
        if type == FAILED:
            outcome[id] = "failed"
        elif type not in (DONE, LATER):
            outcome[id] = "ignored"
        elif number <= 0 or number != int(number):
            outcome[id] = "bad_metadata"
        elif paid != "paid":
            outcome[id] = "awaiting_payment"
        elif int(number) not in state:
            outcome[id] = "unknown_booking"
        else:
            b = state[int(number)]
            if b["session"] and b["session"] != session:
                outcome[id] = "session_mismatch"
            elif b["paid"]:
                outcome[id] = "duplicate"
            else:
                outcome[id] = "applied"
                b.update(paid=True, session=session)
    return outcome, state


@pytest.mark.parametrize("seed", range(4))
def test_batch_equals_one_event_at_a_time(frame, seed):
    bookings, events = random_world(seed)
    expected, state = judge(bookings, sorted(events, key=lambda e: (e[1], e[0])))
    replay = jobs.payment_replay(frame(EVENT, *events), frame(BOOKING, *bookings), NOW)
    assert column(replay.outcomes, "outcome", "event_id") == expected
    after = as_dicts(replay.bookings, "id")
    winners = {int(float(events[i][3])): events[i] for i, o in expected.items() if o == "applied"}
    for id, status, paid, session, price, _ in bookings:
        row = after[id]
        assert (row["payment_status"] == "paid") == state[id]["paid"]
        assert row["total_price"] == price and row["currency"] == "eur"
        if id in winners:
            assert (row["status"], row["stripe_payment_intent_id"]) == ("paid_confirmed", winners[id][6])
            assert row["stripe_checkout_session_id"] == winners[id][5] and str(row["updated_at"]) == NOW
        else:
            assert (row["status"], row["stripe_checkout_session_id"], row["updated_at"]) == (status, session, None)


def test_replay_does_not_depend_on_row_order(frame):
    bookings, events = random_world(9)
    mixed = random.Random(1).sample(events, len(events))
    one = payments.payment_event_classify(frame(EVENT, *events), frame(BOOKING, *bookings))
    two = payments.payment_event_classify(frame(EVENT, *mixed), frame(BOOKING, *bookings))
    assert column(one, "outcome", "event_id") == column(two, "outcome", "event_id")


def test_booking_that_starts_paid_never_binds(frame):
    bookings = [(1, "x", "paid", None, 1, "eur"), (2, "x", "paid", "s1", 1, "eur")]
    events = [(i, "2026-01-01 00:00:00", DONE, b, "paid", s, None) for i, (b, s) in enumerate([("1", "s1"), ("1", "s2"), ("2", "s1"), ("2", "s2")])]
    got = column(payments.payment_event_classify(frame(EVENT, *events), frame(BOOKING, *bookings)), "outcome", "event_id")
    assert [got[i] for i in range(4)] == ["duplicate", "duplicate", "duplicate", "session_mismatch"]


def test_redelivered_events_are_applied_once(spark, frame, tmp_path):
    """Copies of a delivery, in one batch and over several: one is applied, no outcome is multiplied."""
    bookings, events = random_world(5, 120)
    copies = sorted([e for e in events for _ in range(1 + e[0] % 3)], key=lambda e: (e[1], e[0]))
    expected = []
    state = {b[0]: b for b in bookings}
    for n, e in enumerate(copies):
        outcome, after = judge(state.values(), [e])
        expected.append((e[0], outcome[e[0]]))
        for i, b in state.items():
            state[i] = (*b[:2], "paid" if after[i]["paid"] else b[2], after[i]["session"], *b[4:])
    got = payments.payment_event_classify(frame(EVENT, *copies), frame(BOOKING, *bookings))
    assert sorted((r.event_id, r.outcome) for r in got.collect()) == sorted(expected)
    log = stream.OutcomeLog(str(tmp_path / "log"), 2, 2, 2)
    cuts = [0, 1, 40, 41, 43, 100, len(copies)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        stream.judge_batch(frame(EVENT, *copies[a:b]), n, frame(BOOKING, *bookings), log)
    assert sorted((r.event_id, r.outcome) for r in log.read(spark).collect()) == sorted(expected)


def test_counts(frame):
    bookings, events = random_world(2)
    classified = payments.payment_event_classify(frame(EVENT, *events), frame(BOOKING, *bookings))
    counts = payments.payment_event_counts(classified)
    assert counts.agg(F.sum("events")).first()[0] == len(events)


def test_intent_is_text_or_object(frame):
    df = frame("event_id int, payment_intent string", (1, "pi_1"), (2, '{"id":"pi_2","amount":5}'), (3, None), (4, '{"amount":5}'))
    assert column(payments.payment_intent_extract(df), "payment_intent_id", "event_id") == {1: "pi_1", 2: "pi_2", 3: None, 4: None}


def document(event, as_object):
    id, ts, type, booking, paid, session, intent = event
    made = int(__import__("datetime").datetime.fromisoformat(ts + "+00:00").timestamp())
    metadata = {} if booking is None else {"booking_id": booking}
    return json.dumps({"id": f"evt_{id:05d}", "created": made, "type": type, "data": {"object": {
        "id": session, "payment_status": paid, "currency": "nok", "metadata": metadata,
        "payment_intent": {"id": intent} if as_object else intent}}})


@pytest.mark.parametrize("seed,every", [(0, 2), (1, 1), (2, 100)])
def test_stream_in_several_batches_equals_the_replay(spark, frame, tmp_path, seed, every):
    bookings, events = random_world(seed)
    events = sorted(events, key=lambda e: (e[1], e[0]))
    # batches split between moments, so arrival order is time order
    cuts = [f"2026-01-01 00:{m}:00" for m in (15, 16, 40, 45, 50)] + ["2027-01-01 00:00:00"]
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    source.mkdir()
    owned, log = frame(BOOKING, *bookings), stream.OutcomeLog(str(tmp_path / "log"), every, 2, 2)
    done = 0
    for n, cut in enumerate(cuts):
        part = [e for e in events[done:] if e[1] < cut]
        done += len(part)
        (source / f"part-{n}.json").write_text("\n".join(document(e, e[0] % 2 == 0) for e in part) + "\n")
        if n % 2:  # two files per start; the query goes on from its checkpoint
            flat = stream.json_event_source(spark, str(source), max_files=1)
            stream.start_payment_stream(flat, lambda _: owned, log, str(checkpoint)).awaitTermination()
    got = log.read(spark)
    expected, _ = judge(bookings, events)
    assert column(got, "outcome", "event_id") == {f"evt_{i:05d}": o for i, o in expected.items()}
    assert got.count() == len(events) and got.select("batch").distinct().count() == 6
    assert got.where("payment_intent_id not like 'pi_%'").count() == 0


def test_a_batch_run_twice_leaves_one_outcome_per_event(spark, frame, tmp_path):
    bookings, events = random_world(3, 60)
    batch, owned, log = frame(EVENT, *events), frame(BOOKING, *bookings), stream.OutcomeLog(str(tmp_path / "log"), 2, 2, 2)
    for n in (0, 0, 1, 2, 2, 3, 4, 4):
        stream.judge_batch(batch, n, owned, log)
    first = log.read(spark).where("batch = 0")
    assert column(first, "outcome", "event_id") == judge(bookings, sorted(events, key=lambda e: (e[1], e[0])))[0]
    # the same events delivered again find every booking paid
    for n in range(1, 5):
        again = log.read(spark).where(f"batch = {n}")
        assert again.where("outcome = 'applied'").count() == 0 and again.count() == 60


def test_bookings_made_meanwhile_are_found(spark, frame, tmp_path):
    event = (1, "2026-01-01 00:00:00", DONE, "7", "paid", "s", "pi_1")
    source = tmp_path / "in"
    source.mkdir()
    log, made = stream.OutcomeLog(str(tmp_path / "log"), 100, 2, 2), []
    for n in range(2):
        (source / f"part-{n}.json").write_text(document((n, *event[1:]), False) + "\n")
        flat = stream.json_event_source(spark, str(source), max_files=1)
        stream.start_payment_stream(
            flat, lambda _: frame(BOOKING, *made), log, str(tmp_path / "checkpoint")).awaitTermination()
        made.append((7, "x", None, None, 1, "eur"))
    assert column(log.read(spark), "outcome", "event_id") == {"evt_00000": "unknown_booking", "evt_00001": "applied"}


def test_stored_bookings_are_neither_shuffled_nor_read_as_a_whole(spark, frame, tmp_path):
    """Without broadcasts: no exchange above the stored tables, and only touched parts among their files."""
    state = BookingState(str(tmp_path / "state"), parts=8, buckets=4)
    state.add_bookings(frame(BOOKING, *[(i, "x", None, None, 1, "eur") for i in range(200)]), "first")
    state.bind(frame("id long, session_id string", *[(i, f"s{i}") for i in range(0, 200, 3)]), 0)
    ids = frame("id long", (3,), (4,), (999,)).distinct()
    parts = state.touched_parts(ids)
    assert 1 <= len(parts) <= 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = state.after(ids, 1)
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert {r.id: (r.payment_status, r.stripe_checkout_session_id) for r in after.collect()} == {3: ("paid", "s3"), 4: (None, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    for kind in ("bookings", "bound"):
        at, = [n for n, line in enumerate(lines) if f"spark_catalog.default.{kind}_" in line]
        depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
        for line in reversed(lines[:at]):
            if len(line) - len(line.lstrip(" :+-")) < depth:
                depth = len(line) - len(line.lstrip(" :+-"))
                above.append(line)
        assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in above)
        assert f"({len(parts)} paths)" in lines[at] or kind == "bound"
    state.forget(spark)


def test_state_survives_reruns_snapshots_and_a_new_catalog(spark, frame, tmp_path):
    state = BookingState(str(tmp_path / "state"), parts=2, buckets=2, snapshot_every=2)
    pairs = "id long, session_id string"
    known = {}
    for batch in range(6):
        rows = [(batch * 10 + k, f"s{batch}") for k in range(3)] if batch != 3 else []
        for _ in range(2):  # each batch twice
            bound = state.bound(spark, batch, range(2))
            assert {r.id: r.session_id for r in bound.collect()} == known
            state.bind(frame(pairs, *rows), batch)
        known |= dict(rows)
        state.forget(spark)
    kept = [p for p in (tmp_path / "state" / "bound").glob("part=*/gen=*")]
    assert len(kept) <= 2 * 3 and len(list((tmp_path / "state" / "heads").glob("batch=*"))) == 2
