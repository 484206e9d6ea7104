import pytest
from pyspark.sql import functions as F
from tests.conftest import as_dicts, column

from lendlane.operators import config, gates
from lendlane.sources.golden import global_euro_markets, golden
from lendlane.sources.tables import TABLE_SCHEMAS

NOW = "2026-07-06 00:00:00"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TABLE_SCHEMAS["country_config"])


@pytest.fixture(scope="module")
def base(spark, empty):
    launch = golden(spark, "country_base")
    return config.upsert_country(empty, launch, NOW, ["country_name", "currency"], config.LAUNCH_SWITCHES)


@pytest.fixture(scope="module")
def markets(spark, base):
    return config.upsert_country(base, golden(spark, "country_markets"), NOW)


@pytest.fixture(scope="module")
def euro(spark, base):
    return config.upsert_country(base, global_euro_markets(golden(spark, "country_markets")), NOW)


def gate(spark, frame, rule, cfg, policy, *codes):
    asked = frame("id int, country string", *enumerate(codes))
    got = column(rule(asked, "country", cfg, policy, "ok"), "ok")
    return [got[i] for i in range(len(codes))]


def test_launch_rows_take_defaults(base):
    rows = as_dicts(base, "country_code")
    assert len(rows) == 43
    assert rows["BG"]["currency"] == "bgn" and rows["EE"]["country_status"] == "ACTIVE"
    assert rows["EE"]["market_status"] == "blocked" and rows["EE"]["host_enabled"] is False
    assert float(rows["EE"]["platform_fee_percent"]) == 10 and rows["EE"]["tax_mode"] == "NONE"


def test_market_counts(markets):
    counts = as_dicts(gates.market_status_counts(markets), "market_status")
    assert {k: v["countries"] for k, v in counts.items()} == {"live": 21, "beta": 23, "blocked": 7}
    assert counts["live"]["in_euro"] == 21


def test_global_euro_counts(spark, frame, euro):
    assert euro.where("market_status = 'live'").count() == 51
    assert euro.where("currency <> 'eur'").count() == 0
    assert euro.where("payouts_enabled").count() == 21
    ready = gates.country_readiness(euro, "deny")
    assert ready.where("can_take_paid_booking").count() == 51
    assert gate(spark, frame, gates.gate_booking, euro, "deny", "US", "XX") == [True, False]
    assert gate(spark, frame, gates.gate_payout, euro, "deny", "US") == [False]


def test_open_all_counts(spark, frame, euro):
    opened = config.config_open_all(euro, NOW)
    assert opened.where("payouts_enabled").count() == 51
    assert opened.where("market_status <> 'live'").count() == 0
    assert gate(spark, frame, gates.gate_booking, opened, "open", "EE", "US", "NG", "XX") == [True] * 4
    assert gate(spark, frame, gates.gate_payout, opened, "open", "XX") == [True]


def test_deny_gates_over_markets(spark, frame, markets):
    assert gate(spark, frame, gates.gate_booking, markets, "deny", "EE", "SE", "IN", "XX", None) == [
        True, False, False, False, False]
    assert gate(spark, frame, gates.gate_payout, markets, "deny", "EE", "XX") == [True, False]


def test_lookup_folds_case_but_does_not_trim(spark, frame, markets):
    # ' in ' finds no row: open allows it, deny refuses it
    assert gate(spark, frame, gates.gate_booking, markets, "open", "in", " in ", "  ", "") == [False, True, True, True]
    assert gate(spark, frame, gates.gate_booking, markets, "deny", "ee", " ee ", "  ") == [True, False, False]


def test_deny_implies_open(spark, frame, markets):
    codes = [r.country_code for r in markets.select("country_code").collect()] + ["XX", None, ""]
    denying = gate(spark, frame, gates.gate_booking, markets, "deny", *codes)
    opening = gate(spark, frame, gates.gate_booking, markets, "open", *codes)
    assert all(o or not d for d, o in zip(denying, opening))


def test_waitlist_does_not_block(spark, frame, empty):
    source = frame("country_code string, country_status string", ("WL", "WAITLIST"), ("DD", "DISABLED"))
    cfg = config.upsert_country(empty, source, NOW)
    assert gate(spark, frame, gates.gate_booking, cfg, "open", "WL", "DD") == [True, False]


def test_host_report(frame, markets):
    hosts = frame("id bigint, host_uid string, country_code string", (1, "a", "ee"), (2, "b", "se"), (3, "c", None), (4, "d", "xx"))
    deny = as_dicts(gates.gate_report_columns(gates.host_gate_report(hosts, markets, "deny")), "host_uid")
    assert deny["a"]["can_book"] and deny["a"]["reason"] == "OK" and deny["a"]["country_code"] == "EE"
    assert deny["b"]["currency"] == "sek" and deny["b"]["reason"] == "Country is not enabled yet"
    assert deny["c"]["country_code"] == "" and deny["c"]["country_status"] == "DISABLED"
    opened = as_dicts(gates.gate_report_columns(gates.host_gate_report(hosts, markets, "open")), "host_uid")
    assert opened["b"]["currency"] == "eur" and opened["d"]["market_status"] == "live"
    assert not opened["b"]["can_book"] and opened["b"]["reason"] == "Country is disabled by admin"
    text = as_dicts(gates.gate_report_json(gates.host_gate_report(hosts, markets, "open")), "host_uid")["d"]["gate"]
    assert text.startswith('{"can_book":true,"country_code":"XX"')


def test_readiness_columns_and_order(markets):
    view = gates.country_readiness(markets)
    assert view.columns == gates.READINESS_CURRENT
    keys = [(r.market_status, r.country_code) for r in view.collect()]
    assert keys == sorted(keys) and keys[0][0] == "beta"
    assert gates.country_readiness(markets, form="first").columns == gates.READINESS_FIRST


def test_upsert_keeps_unlisted_columns(frame):
    old = frame("app string, min_build int, android_url string, updated_at timestamp_ntz", ("client", 3, "old", "2020-01-01"), ("x", 1, "x", "2020-01-01"))
    new = frame("app string, min_build int, android_url string", ("client", 0, "new"), ("host", 0, "host"))
    got = as_dicts(config.upsert_partial(old, new, NOW), "app")
    assert got["client"]["min_build"] == 3 and got["client"]["android_url"] == "new"
    assert str(got["client"]["updated_at"]) == NOW and str(got["x"]["updated_at"]) == "2020-01-01 00:00:00"
    assert got["host"]["min_build"] == 0 and len(got) == 3


def test_upsert_refuses_a_repeated_source_key(frame):
    old = frame("app string, android_url string", ("a", "x"))
    new = frame("app string, android_url string", ("b", "1"), ("b", "2"))
    with pytest.raises(Exception, match="two source rows"):
        config.upsert(old, new, "app", ["android_url"], NOW).collect()


def test_upsert_twice_is_upsert_once(spark, markets):
    again = config.upsert_country(markets, golden(spark, "country_markets"), NOW)
    assert again.exceptAll(markets).count() == 0


def test_overlay_tells_null_from_unset(frame):
    a = frame("country_code string, x string, y string", ("A", "1", "1"), ("B", "1", "1"))
    b = frame("country_code string, x string", ("A", None))
    c = frame("country_code string, y string", ("B", "3"), ("C", "3"))
    got = as_dicts(config.config_overlay([a, b, c]), "country_code")
    assert (got["A"]["x"], got["A"]["y"]) == (None, "1")
    assert (got["B"]["x"], got["B"]["y"]) == ("1", "3")
    assert (got["C"]["x"], got["C"]["y"]) == (None, "3")


def test_constraint_audit_lets_null_pass(frame):
    bad = frame("country_code string, tax_mode string, stripe_mode string", ("A", "x", None), ("B", None, "direct"), ("C", "NONE", "y"))
    got = {(r.country_code, r.constraint_column, r.bad_value) for r in config.config_constraint_audit(bad).collect()}
    assert got == {("A", "tax_mode", "x"), ("C", "stripe_mode", "y")}


def test_golden_markets_pass_the_audit(markets):
    assert config.config_constraint_audit(markets).count() == 0


def test_touch_only_changed_rows(frame):
    old = frame("id int, v string, updated_at timestamp_ntz", (1, "a", "2020-01-01"), (2, None, "2020-01-01"), (3, "c", "2020-01-01"))
    new = old.withColumn("v", F.when(F.col("id") == 3, "d").otherwise(F.col("v")))
    got = column(config.touch_updated_at(old, new, "id", NOW), "updated_at")
    assert [str(got[i])[:4] for i in (1, 2, 3)] == ["2020", "2020", "2026"]


def test_mirrors(markets):
    row = config.generated_mirrors(markets).where("country_code = 'SE'").first()
    assert (row.payment_enabled, row.payout_enabled, row.default_currency) == (False, False, "sek")
