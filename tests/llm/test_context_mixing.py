import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lendlane.llm import context_mixing as cm
from tests.conftest import as_dicts


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


@pytest.fixture(scope="module")
def rows(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        frame("doc_id long, text string", (-1, None), (-2, ""), (None, "The of"), (-3, "the OF"), (-4, "the of"), (-4, "the of"), (-5, "zq " * 40000)))
    return docs, as_dicts(docs), as_dicts(cm.scored(docs.selectExpr("doc_id", "text", "1 as score")))


def test_base(rows):
    _, given, got = rows
    count = Counter(t for r in given if learns(r["doc_id"]) for t in tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    want = sorted((str(r["doc_id"]), len(tokens(r["text"])), sum(count[t] > 0 for t in tokens(r["text"])),
                   sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(r["text"]))) for r in given)
    assert {r["train_tokens"] for r in got} == {n}
    for w, g in zip(want, sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in got), strict=True):
        assert w[:3] == g[:3] and w[3] == pytest.approx(g[3], rel=1e-9)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_held_out_texts_score_well(rows):
    _, given, got = rows
    held = {r["doc_id"]: r for r in got if r["held_out"]}
    size = sum(len((r["text"] or "").encode()) + 1 for r in given if r["doc_id"] in held)
    assert -sum(r["score"] for r in held.values()) / math.log10(2) / size < 2.5  # bits per byte
    same = {r["score"] for r in got if r["doc_id"] in (None, -3, -4)}
    assert len(same) == 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_same_on_other_partitions(rows):
    docs, _, got = rows
    again = as_dicts(cm.scored(docs.repartition(7)))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
    for a, b in zip(sorted(got, key=key), sorted(again, key=key), strict=True):
        assert a["score"] == pytest.approx(b["score"], rel=1e-6)


def test_bytes_add_up_to_one():
    raw = [b"the cat sat on the mat", b"the dog sat", b"a cat and a dog sat on a mat"] * 3
    numbers, counts = np.unique(cm.strings(raw)[0], return_counts=True)
    pairs = np.bincount((numbers & np.uint64(0xFFFF)).astype(int), counts, 1 << 16).reshape(256, 256)
    bucket = cm.Bucket(numbers, counts, pairs)
    settings = cm.Settings()
    weights = cm.Weights(pairs, np.full((cm.GATES, cm.INPUTS), 0.3))
    better = cm.Weights(pairs, cm._learned(bucket, weights, settings)[0])
    for context in (b"e cat", b"zzzzz", b"\xff\xff\xfft "):
        first = np.uint64(int.from_bytes(context, "big") << 8)
        p = 10 ** cm.log_probabilities(bucket, first + np.arange(256, dtype=np.uint64), better, settings)
        assert p.sum() == pytest.approx(1, abs=1e-4)
    old, new = (cm.log_probabilities(bucket, numbers, w, settings) @ counts for w in (weights, better))
    assert new > old


def test_strings_and_packing():
    keys, text = cm.strings([b"ab", b""])
    assert [int(k).to_bytes(6, "big") for k in keys] == [b"\xff" * 5 + b"a", b"\xff" * 4 + b"ab", b"\xff\xff\xffab\xff", b"\xff" * 6]
    assert text.tolist() == [0, 0, 0, 1]
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (cm._unpack(cm._pack(values)) == values).all()


def test_empty(frame):
    assert cm.scored(frame("doc_id long, text string")).count() == 0


def test_numbers_are_looked_up_in_ascending_order(monkeypatch):
    dice = np.random.default_rng(4)
    numbers = np.unique(dice.integers(0, 1 << 48, 3000).astype(np.uint64))
    asked, search, ascending = dice.choice(numbers, 20_000), np.searchsorted, []

    def watched(known, wanted, *more, **options):
        ascending.append(bool((wanted[1:] >= wanted[:-1]).all()))
        return search(known, wanted, *more, **options)

    monkeypatch.setattr(np, "searchsorted", watched)
    assert (numbers[cm._found(numbers, asked)] == asked).all() and ascending == [True]
    assert len(cm._found(numbers, asked[:0])) == 0
