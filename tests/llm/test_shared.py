import random

import numpy as np

from lendlane.llm import shared
from tests.conftest import as_dicts


def plain(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def graph(seed):
    dice = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(7, i) for i in range(200, 260)]
    return chain + star + [(dice.randrange(1000, 1300), dice.randrange(1000, 1300)) for _ in range(250)] + [(5, 5), (3, 4), (3, 4), (-9, 3)]


def test_components(frame, monkeypatch):
    edges = [e for e in graph(1)]
    want = {k: v for k, v in plain([e for e in edges if e[0] != e[1]]).items()}
    df = frame("a long, b long", *edges, (None, 1), (2, None)).repartition(6)
    for most in (500_000, 60):
        monkeypatch.setattr(shared, "EDGES_PER_TASK", most)
        rows = as_dicts(shared.components(df))
        assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert shared.components(df.limit(0)).count() == 0


def test_local_components():
    for seed in range(5):
        edges = np.array(graph(seed))
        node, least = shared.local_components(edges[:, 0], edges[:, 1])
        assert dict(zip(node.tolist(), least.tolist())) == plain([tuple(e) for e in edges.tolist()])


def test_word_ranges_and_hashes():
    data = np.frombuffer(b" ab\tc  d\n\xc3\xa9 ab", np.uint8)
    start, end = shared.word_ranges(data)
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab", b"c", b"d", "é".encode(), b"ab"]
    hashes = shared.PrefixHash(data).of(start, end)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
