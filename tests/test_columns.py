from pyspark.sql import functions as F

from lendlane.functions.columns import blur, epoch_micros, js_positive_id, js_round_cents, js_trim, moment


def one(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_ids_read_like_javascript_numbers(frame):
    cases = [
        ("12", 12), (" 12\n", 12), ("12.0", 12), ("+12", 12), ("007", 7), ("1e3", 1000), ("1.5e1", 15), ("0x1F", 31),
        ("0b101", 5), ("0o17", 15), ("12.", 12), (".5e1", 5), (" 12", 12), ("99999999", 99999999),
        ("9007199254740993", 9007199254740993),
        ("12.5", None), ("-1", None), ("0", None), ("", None), ("abc", None), ("12d", None), ("12abc", None),
        (None, None), ("1e-3", None), ("0x0", None), ("Infinity", None), ("NaN", None), ("1 2", None),
    ]
    df = frame("id int, t string", *[(n, c[0]) for n, c in enumerate(cases)])
    got = {r.id: r.v for r in df.select("id", js_positive_id("t").alias("v")).collect()}
    assert [(c[0], got[n]) for n, c in enumerate(cases)] == cases


def test_trim_takes_all_whitespace(frame):
    df = frame("t string", ("\t a b \n",), ("﻿x",), ("",))
    assert one(df, js_trim("t")) == ["a b", "x", ""]


def test_cents_round_halves_up_in_binary(frame):
    df = frame("a decimal(16,5)", ("0.30",), ("10.075",), ("1.005",), ("-0.005",), ("2.5",), (None,))
    # 10.075 * 100 is 1007.4999999999999 in binary, 1.005 * 100 is 100.49999999999999; -0.5 rounds up to 0
    assert one(df, js_round_cents("a")) == [30, 1007, 100, 0, 250, None]


def test_blur_rounds_half_away_from_zero(frame):
    df = frame("c decimal(10,6)", ("0.125",), ("-0.125",), ("59.4349",), (None,))
    assert one(df, blur("c")) == [0.13, -0.13, 59.43, None]
    assert one(frame("c double", (0.125,), (2.675,)), blur("c")) == [0.13, 2.68]


def test_moment_ignores_the_process_time_zone(spark):
    assert str(spark.range(1).select(moment("1998-06-15 00:00:00")).first()[0]) == "1998-06-15 00:00:00"
    assert dict(spark.range(1).select(moment("1998-06-15").alias("t")).dtypes)["t"] == "timestamp_ntz"


def test_micros_keep_their_order_in_any_session_zone(spark, frame):
    # 02:30 does not exist in Tallinn on that day, and an instant would put it after 03:10
    moments = ["1969-12-31 23:59:59.999999", "2024-03-31 02:30:00", "2024-03-31 03:10:00.25", "2024-10-27 03:30:00.000001"]
    df = frame("t timestamp_ntz", *[(m,) for m in moments], (None,))
    zone = spark.conf.get("spark.sql.session.timeZone")
    expected = [-1, 1_711_852_200_000_000, 1_711_854_600_250_000, 1_729_999_800_000_001, None]
    try:
        for name in ("UTC", "Europe/Tallinn"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert one(df, epoch_micros(df, "t")) == expected
            assert one(df.select(F.col("t").cast("timestamp")), F.unix_micros("t"))[4] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    instants = frame("t timestamp", ("2024-03-31 02:30:00",))
    assert one(instants, epoch_micros(instants, "t")) == one(instants, F.unix_micros("t"))
