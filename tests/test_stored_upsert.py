import pathlib

import pytest

from lendlane.plans.stored_upsert import StoredTable
from tests.conftest import as_dicts

KIND = "k string, a int, b string, updated_at timestamp_ntz"
AS_OF = "2026-07-06 00:00:00"


@pytest.fixture
def table(frame, tmp_path):
    stored = StoredTable(str(tmp_path / "t"), KIND, "k", 16)
    stored.create(frame("k string, a int", *[(f"k{i}", i) for i in range(100)], (None, -1)))
    return stored


def files(table):
    return {p: p.stat().st_mtime_ns for p in pathlib.Path(table.folder, "rows").glob("bucket=*/*.parquet")}


def test_only_touched_buckets_are_written(spark, frame, table):
    before = files(table)
    source = frame("k string, a int, b string", ("k7", 700, "new b"), ("fresh", 1, "x"))
    assert table.merge(source, "one", AS_OF, ["a"], {"b": "default"})
    got = as_dicts(table.read(spark), "k")
    assert len(got) == 102 and (got["k7"]["a"], got["k7"]["b"]) == (700, None)  # b is not among the updated columns
    assert (got["fresh"]["a"], got["fresh"]["b"]) == (1, "x") and got["k8"] == {"k": "k8", "a": 8, "b": None, "updated_at": None}
    after = files(table)
    same = {p for p in before if after.get(p) == before[p]}
    assert len({p.parent for p in before} - {p.parent for p in same}) <= 2 and len(same) >= len(before) - 2
    # the same name again changes nothing, an empty source neither
    assert not table.merge(source, "one", "2027-01-01 00:00:00", ["a"]) and files(table) == after
    table.merge(source.limit(0), "two", AS_OF, ["a"])
    assert files(table) == after


def test_an_upsert_that_dies_is_finished(spark, frame, table, monkeypatch):
    source = frame("k string, a int", *[(f"k{i}", 0) for i in range(0, 100, 2)])
    publish = StoredTable._publish
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(source, "one", AS_OF, ["a"])
    assert table.read(spark).where("a = 0").count() == 1
    with pytest.raises(Exception, match="two source rows"):
        table.merge(frame("k string, a int", ("k1", 5), ("k1", 6)), "two", AS_OF, ["a"])  # finishes the first, then fails
    assert StoredTable._publish is publish
    got = as_dicts(table.read(spark), "k")
    assert len(got) == 101 and all(got[f"k{i}"]["a"] == (i if i % 2 else 0) for i in range(100)) and got[None]["a"] == -1


def test_other_buckets_are_not_read(spark, table):
    plan = table.read(spark, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan and "PartitionFilters: [bucket" in plan
