import hashlib

import pytest
from pyspark.errors import PySparkException

from lendlane.operators.changes import table_changes

KIND = "k string, a int, b string, x double, l array<string>, updated_at timestamp_ntz"


def changes(old, new):
    return {r.k: (r.change, r.changed_columns) for r in table_changes(old, new, "k").collect()}


def test_inserted_deleted_and_changed_columns(frame):
    old = frame(KIND, ("same", 1, None, float("nan"), ["u"], "2020-01-01"), ("gone", 1, "x", 0.0, None, None), ("set", None, "x", 0.0, None, None),
                (None, 1, "x", 0.0, None, None), ("list", 1, "x", 0.0, ["a", None], None), ("blank", 1, "", 0.0, None, None))
    new = frame(KIND, ("same", 1, None, float("nan"), ["u"], "2021-01-01"), ("set", 0, "y" * 9000, -0.0, None, None),
                (None, 2, "x", 0.0, None, None), ("list", 1, "x", 0.0, ["a"], None), ("blank", 1, None, 0.0, None, None), ("new", 1, "x", 0.0, None, None))
    assert changes(old, new) == {
        "gone": ("deleted", None), "new": ("inserted", None), "set": ("changed", "a,b"), None: ("changed", "a"),
        "list": ("changed", "l"), "blank": ("changed", "b")}


def test_empty_versions_and_columns_of_one_version_only(frame):
    rows, none = frame("k string, a int", ("p", 1), ("q", None)), frame("k string, a int")
    assert changes(none, rows) == {"p": ("inserted", None), "q": ("inserted", None)}
    assert changes(rows, none) == {"p": ("deleted", None), "q": ("deleted", None)}
    assert changes(none, none) == {} == changes(rows, frame("k string, other int", ("p", 5), ("q", 6)))
    # a column of another type counts by its value
    assert changes(rows, frame("k string, a bigint, _new int", ("p", 1, 1), ("q", 2, 1))) == {"q": ("changed", "a")}


def test_a_key_that_occurs_twice_is_an_error(frame):
    rows = frame("k string, a int", ("p", 1), ("p", 2))
    with pytest.raises(PySparkException, match="key twice in one version: p"):
        table_changes(rows, rows, "k").collect()


def test_rows_are_not_sorted_by_the_tasks_that_read_them(frame):
    rows = frame("k string, a int, b string", ("p", 1, "x"), ("q", None, "y" * 40))
    plan = table_changes(rows, frame("k string, a int, b string", ("p", 2, "x")), "k")._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.split("== Initial Plan ==")[-1].partition("Exchange")
    assert "Aggregate" in above and "Sort " in above
    assert "Aggregate" not in below and "Sort " not in below and "Exchange" not in below


def test_texts_around_the_length_of_a_digest(frame):
    kind = "k int, b string, c binary"
    old = frame(kind, *[(n, "x" * n, b"x" * n) for n in (30, 31, 32, 33)])
    new = frame(kind, *[(n, "x" * (n - 1) + "y", hashlib.sha256(b"x" * n).digest()) for n in (30, 31, 32, 33)])
    assert changes(old, new) == {n: ("changed", "b,c") for n in (30, 31, 32, 33)}
    assert changes(old, old) == {}
