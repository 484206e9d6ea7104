import hashlib
import random

import numpy as np
import pytest

from lendlane.llm import repeats, suffixes
from lendlane.llm.suffixes import common_prefixes, suffix_array
from tests.conftest import as_dicts


def plain(rows, length):
    order = sorted(set((NO if i is None else i, t or "") for i, t in rows))
    seen, out = {}, {}
    for doc, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s:s + length], (doc, s)) < (doc, s):
                gone[s:s + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[doc, text] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return sorted((str(i), *out[NO if i is None else i, t or ""]) for i, t in rows)


NO = repeats.NO_ID


def got(docs, **options):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in as_dicts(repeats.without_repeats(docs, **options)))


def test_suffix_arrays():
    dice = np.random.default_rng(1)
    for _ in range(300):
        a = dice.integers(0, dice.integers(1, 5), dice.integers(1, 60)).astype(np.uint8)
        order = suffix_array(a, 1000)
        assert order.tolist() == sorted(range(len(a)), key=lambda i: bytes(a[i:]))
        shared = common_prefixes(a, order, 7)
        for i, j in zip(order, order[1:]):
            x, y = bytes(a[i:i + 7]), bytes(a[j:j + 7])
            assert shared[j] == next((k for k in range(8) if x[:k + 1] != y[:k + 1] or k >= min(len(x), len(y))), 7)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(frame, seed):
    dice = random.Random(seed)
    words = ["the", "ean", "tion", "é", "x", "or ing", "qu", "aa", "😀"]
    say = lambda n: " ".join(dice.choice(words) for _ in range(n))
    shared, rows = [say(20) for _ in range(5)], []
    for _ in range(120):
        text = " ".join(dice.choice([say(dice.randrange(30)), dice.choice(shared), "ab" * dice.randrange(40)]) for _ in range(dice.randrange(5)))
        rows.append((dice.randrange(10_000), text))
    rows += [(dice.randrange(10_000), t) for _, t in rows[:25]]
    rows += [(20_000, None), (20_001, ""), (None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (20_002, "z" * 3000)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(3, rows[-3][1])]
    rows = [r for r in rows if r[0] != 3] + [r for r in rows if r[0] == 3][-1:] * 2
    docs = frame("doc_id long, text string, sign string", *[(*r, "x") for r in rows])
    assert got(docs, length=40, piece=12) == plain(rows, 40)


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == plain([(r["doc_id"], r["text"]) for r in as_dicts(docs)], 100)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_anchors_of_a_slice_longer_than_its_places(monkeypatch):
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    dice = np.random.default_rng(4)
    same = dice.integers(0, 256, 700, np.uint8).tobytes()
    texts = [dice.integers(0, 256, n, np.uint8).tobytes() + same + dice.integers(0, 256, 900, np.uint8).tobytes() for n in (50, 3210)]
    anchors = []
    for text in texts:
        hashes, _, first, last = repeats.Slice([text], 100, 32).anchors()
        of = {p: h for h, a, b in zip(hashes.tolist(), first.tolist(), last.tolist()) for p in range(a, b + 1)}
        assert len(of) == len(text) - 99
        anchors.append([of[text.index(same) + k] for k in range(601)])
    assert anchors[0] == anchors[1]


def test_whole_buckets_are_followed_at_once(monkeypatch):
    calls, place = [], suffixes._before
    monkeypatch.setattr(suffixes, "_before", lambda *a: (calls.append(1), place(*a))[1])
    dice = np.random.default_rng(5)
    text = np.concatenate([dice.permutation(60) for _ in range(60)])
    text = np.append(text, np.append(np.repeat(7, 30), text[:150]))
    order = suffixes.suffix_array(text, 200)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    # two scans, of 61 symbols, three rounds a bucket and its own suffixes, but for the run of 30; names of the recursion are sorted by doubling
    assert len(calls) <= 2 * 61 * 4 + 2 * 30


def test_anchors_know_their_texts():
    dice = np.random.default_rng(6)
    raw = [dice.bytes(n) for n in (0, 300, 99, 0, 0, 100, 101, 5, 700, 0)]
    own = repeats.Slice(raw, 100, 32)
    hashes, text, first, last = own.anchors()
    assert len(hashes) and sum(last - first + 1) == sum(max(len(r) - 99, 0) for r in raw)
    assert (own.starts[text] <= first).all() and (last + 100 <= own.ends[text]).all()
