import math
import re
from collections import Counter

import numpy as np

from lendlane.llm import lexical
from tests.conftest import as_dicts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return TERM.findall(lowered)


def plain(items, docs):
    """The contract, document by document."""
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            if bag:
                m = 100 - 75 + 75 * bag.total() * n_docs // n_words
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                            for t in cut(text) if t in bag)
                if score > 0:
                    scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    return sorted(out, key=str)


def found(items, docs, settings=lexical.Settings()):
    got = lexical.search(items, docs, settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r.values()) for r in as_dicts(got)), key=str)


def random_text(rng, words):
    return " ".join(rng.choice(["a", "B", "of,", "é", "Éa", "x1", "ñandú", "the-the", "zeta", "Q", "rare" + str(rng.integers(40))], p=[.2, .2, .1, .1, .1, .05, .05, .1, .04, .02, .04], size=words))


def test_against_a_plain_version(frame):
    rng = np.random.default_rng(6)
    docs = [(i, random_text(rng, int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(5, docs[5][1]), (5, "zeta Q rare1"), (None, docs[9][1]), (None, None)]
    docs += [(2000, None), (2001, ""), (2002, " .,-\n"), (2003, "a b " * 20000), (2004, "ÀÉ é")]
    items = [(k, random_text(rng, 8)) for k in range(12)] + [(50, docs[7][1]), (51, None), (52, "."), (53, "unheard of"), (54, "Q q Q"), (54, "Q q Q"), (None, "rare1 rare2")]
    d = frame("doc_id long, text string, term string, item long", *[(*r, "x", 1) for r in docs])
    b = frame("item_id long, text string, row string, score int", *[(*r, "x", 1) for r in items])
    expected = plain(items, docs)
    assert found(b, d) == expected
    # small buckets, blocks and portions give the same
    assert found(b, d.repartition(6), lexical.Settings(block_items=4, entries=300, bucket=9, focus=2)) == expected
    assert found(b, d, lexical.Settings(block_bytes=60, focus=0, ratio=0.99)) == expected


def test_buckets_are_passed_over():
    """A bucket of short vectors is not looked at, and the filter keeps few rows of the others."""
    ids = np.arange(6)
    bucket = lexical._Bucket(ids, ids, np.array([0, 0, 1, 1, 2, 2]), np.array([9, 8, 7, 6, 5, 4]), np.array([9.0, 8, 7, 6, 5, 4]))
    queries = lexical._Queries({}, np.array([0, 2]), np.array([10, 1]), np.array([0, 2]), 6, 6)
    assert list(bucket.search(queries, np.array([91]), 1)) == []
    (item, rows, scores), = bucket.search(queries, np.array([85]), 1)
    assert (item, rows.tolist(), scores.tolist()) == (0, [0], [90])
    everything = [rows.tolist() for _, rows, _ in bucket.search(queries, np.array([1]), 1)]
    assert everything == [[0, 1, 2, 3, 4, 5]] or everything == [[0, 1, 4, 5]]


def test_empty_tables(frame):
    docs, items = frame("doc_id long, text string", (1, "a b")), frame("item_id int, text string", (1, "a"))
    assert found(items, docs.limit(0)) == [] and found(items.limit(0), docs) == []
    assert found(items, frame("doc_id long, text string", (1, None))) == []
    got = lexical.search(items, docs)
    assert dict(got.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert found(items, docs) == plain([(1, "a")], [(1, "a b")])
