import duckdb
import pytest

from lendlane.llm import mixing
from tests.conftest import as_dicts


def reference_targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_cut(frame):
    rows = [(i, "w " * (1 + i * 7 % 13), f"s{i % 5}" if i % 11 else None, i) for i in range(400)]
    rows += [(1000, None, "s1", 0), (1001, "", "empty", 0), (1002, " \n", "empty", 0), (None, "a b", "s2", 1), (7, "x y z", "s2", 1), (7, "x y z", "s2", 1)]
    docs = frame("doc_id long, text string, source string, size int", *rows)
    got = as_dicts(mixing.mix_documents(docs))
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = reference_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    by_size = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"]
        by_size.setdefault((r["source_size"], r["target"]), []).append(r)
    assert sorted(t for _, t in by_size) == pytest.approx(sorted(want.values()))
    for (_, target), own in by_size.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max([r["size"] for r in own]) / 2 + 1e-9


def test_same_as_sql_and_repeatable(frame, spark, tmp_path):
    docs = frame("doc_id long, text string, source string", *[(i, "a b\tc\n" * (i % 9), "é" if i % 3 else "z") for i in range(300)])
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(f"select doc_id, taken, target from ({mixing.ORACLE})").fetchall())
    for df in (docs, docs.repartition(7)):
        assert sorted(tuple(r) for r in mixing.mix_documents(df).select("doc_id", "taken", "target").collect()) == want


def test_empty(frame):
    assert mixing.mix_documents(frame("doc_id long, text string, source string")).count() == 0
