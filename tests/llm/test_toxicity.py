import zlib

import pytest

from lendlane.llm import toxicity
from tests.conftest import as_dicts

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return docs.count(), as_dicts(got)


def test_held_out_accuracy(scored):
    n, rows = scored
    assert len(rows) == n
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic, clean = ([r["predicted"] for r in held if r["toxic"] == t] for t in (1, 0))
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_odd_rows(frame):
    docs = frame("doc_id long, text string, score string", (1, None, "x"), (2, "", "y"), (None, "nasty words", "z"), (2, "", "y"), (3, "a퟿ " * 30000, None))
    labels = frame("doc_id long, toxic int", (1, 0), (2, 1), (2, 0), (3, None), (None, 1))
    rows = as_dicts(toxicity.toxicity(docs, labels))
    assert len(rows) == 5 and {r["score"] for r in rows if r["doc_id"] in (1, 2)} == {min(r["score"] for r in rows)}
    assert toxicity.without_toxic(docs, labels).columns == ["doc_id", "text", "score"]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(frame):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = frame("doc_id long, toxic int", *[(i, i % 2) for i in range(200)])
    assert {r["doc_id"] for r in as_dicts(toxicity.sampled_labels(labels))} == set(range(200)) - set(held)
    assert toxicity.sampled_labels(labels, toxicity.Settings(toxic_rows=3, ordinary_rows=5)).count() == 8


def test_a_text_that_does_not_fit_is_passed_over(frame):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = frame("doc_id long, toxic int", *[(i, i % 2) for i in ids])
    first = {label: min((r["rank"], r["doc_id"]) for r in as_dicts(toxicity.sampled_labels(labels)) if r["toxic"] == label)[1] for label in (0, 1)}
    texts = {i: ("grobian lummox " if i % 2 else "garden window ") * 3 + f"n{i}" for i in ids}
    docs = frame("doc_id long, text string", *[(i, "x" * 30_000 if i in first.values() else texts[i]) for i in ids])
    settings = toxicity.Settings(sample_chars=40_000)
    model = toxicity.fit(docs, labels, settings)
    assert b"lummox" in model.toxic and b"garden" in model.ordinary and b"xxxx" not in model.ordinary + model.toxic
    with pytest.raises(ValueError, match="toxic = 1"):
        toxicity.fit(docs.where(f"doc_id % 2 = 0 OR doc_id = {first[1]}"), labels, settings)
