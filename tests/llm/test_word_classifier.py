import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lendlane.llm import word_classifier as wc
from tests.conftest import as_dicts

SF = "/root/testdata/sf0.1"


def plain(text, orders):
    """Values per n-gram, and the share of repeated ones: the features before hashing."""
    tokens, k = [], 0
    while k < len(text):
        c = text[k]
        if c in " \t\n\x0b\x0c\r":
            k += 1
            continue
        word = c.isalnum() and c.isascii() or not c.isascii()
        end = k + 1
        while end < len(text) and ((text[end].isalnum() or not text[end].isascii()) if word else text[end] == c):
            end += 1
        tokens.append(text[k:end])
        k = end
    grams, shares = Counter(), []
    for n in orders:
        own = Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))
        shares.append(1 - len(own) / own.total() if own else 0.0)
        grams += own
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in grams.values()))
    return sorted(math.log1p(c) / norm for c in grams.values()), shares


def test_features_against_a_plain_version():
    texts = ["", " \n", "a", "the the the, the!!!", "x$$$ y### $$$", "ä-ö 12ab ab", "one two three one two three\none two", "né " * 400]
    settings = wc.Settings()
    place, value, begins = wc.features(texts, settings)
    hashed = 1 << settings.bits
    for k, text in enumerate(texts):
        p, v = place[begins[k]:begins[k + 1]], value[begins[k]:begins[k + 1]]
        values, shares = plain(text, settings.orders)
        assert np.allclose(sorted(v[p < hashed]), values) and np.allclose(v[p >= hashed], [*shares, 1.0])
        alone = wc.features([text], settings)
        assert (alone[0] == p).all() and np.allclose(alone[1], v, rtol=0, atol=0)
    same = wc.features(["b a", "a b"], settings)
    assert len(set(same[0][:3]) & set(same[0][same[2][1]:same[2][1] + 3])) == 2  # words in common, not their pair


def test_updates_against_a_plain_version():
    rng, settings = np.random.default_rng(5), wc.Settings(bits=3)
    rows = [(np.sort(rng.choice(settings.places, 4, replace=False)), rng.normal(size=4), float(rng.integers(0, 2))) for _ in range(60)]
    own, z, n = wc.Leader(settings), Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= settings.lasso:
            return 0.0
        return -(z[i] - math.copysign(settings.lasso, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.rate + settings.ridge)

    for place, value, y in rows:
        own.learn(place, value, y)
        w = {i: weight(i) for i in place}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in zip(place, value))))
        for i, x in zip(place, value):
            g = (p - y) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.rate * w[i]
            n[i] += g * g
    assert np.allclose(own.weights(), [weight(i) for i in range(settings.places)])


@pytest.mark.parametrize("shard_rows", [4000, 500])
def test_held_out_accuracy(spark, shard_rows):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = wc.quality(docs, labels, wc.Settings(shard_rows=shard_rows)).join(labels.select("doc_id", "quality"), "doc_id", "left")
    rows = as_dicts(got)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good, bad = ([r["predicted"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_odd_rows(frame):
    docs = frame("doc_id long, text string, score string, y string, rank int, quality string",
                 *[(*r, "x", "y", 1, "z") for r in [(1, None), (2, ""), (None, "some words"), (2, ""), (3, "a퟿ " * 30000), (4, "good words"), (6, "bad $$$"), (6, "bad $$$")]])
    labels = frame("doc_id long, quality int, text string", (1, 0, "x"), (2, 1, "x"), (2, 0, "x"), (3, None, "x"), (None, 1, "x"), (4, 1, "x"), (6, 0, "x"))
    rows = as_dicts(wc.quality(docs, labels))
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "2", "3", "4", "6", "6", "None"]
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    assert wc.quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in as_dicts(wc.quality(docs, labels.limit(0)))} == {0.5}
    assert sorted(map(str, rows)) == sorted(map(str, as_dicts(wc.quality(docs.repartition(7), labels.repartition(3)))))


def test_labels_of_held_out_rows_are_not_read(frame):
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = frame("doc_id long, quality int", *[(i, i % 2) for i in range(200)])
    assert {r["doc_id"] for r in as_dicts(wc.sampled_labels(labels))} == set(range(200)) - held
    assert wc.sampled_labels(labels, settings=wc.Settings(rows=7)).count() == 7


def test_states_are_averaged_block_by_block():
    """The mean over shards, as the driver would add it up in the order of shards, comes from blocks of places."""
    import pandas as pd

    settings = wc.Settings(bits=15)
    shards = [
        pd.DataFrame({"shard": k, "rank": range(4), "digest": 0, "y": [0.0, 1.0, 1.0, 0.0], "text": [f"w{j * (k + 1)} a{k} b {j}" for j in range(4)]})
        for k in range(3)
    ]
    states = pd.concat([wc._learned(wc.Leader(settings))(rows) for rows in shards])
    moved, touched, got = np.zeros(settings.places), np.zeros(settings.places), np.zeros(settings.places)
    for r in states.itertuples():
        place = np.frombuffer(r.place, np.int32)
        assert (place // wc.BLOCK == r.block).all()
        touched[place] += 1
        moved[place] += np.frombuffer(r.moved)
    for _, rows in states.groupby("block"):
        mean = wc._averaged(rows.sample(frac=1, random_state=1)).iloc[0]
        got[np.frombuffer(mean.place, np.int32)] = np.frombuffer(mean.moved)
    assert states["block"].nunique() == 3 and touched.max() == 3
    assert np.array_equal(got, moved / np.maximum(touched, 1))
