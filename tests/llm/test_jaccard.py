import random
import re

import numpy as np
import pytest

from lendlane.llm import jaccard
from lendlane.llm.shared import local_components
from lendlane.llm.shingles import shingle_sets
from tests.conftest import as_dicts

WORDS = [f"w{i}" for i in range(400)]


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, families=25, size=12):
    dice, rows = random.Random(seed), []
    passage = [dice.choice(WORDS) for _ in range(60)]
    for _ in range(families):
        base = [dice.choice(WORDS) for _ in range(dice.choice([3, 6, 9, 12, 14, 18, 25, 40, 120]))]
        if dice.random() < .4:
            base += passage
        for _ in range(dice.randrange(1, size)):
            own = list(base)
            for _ in range(dice.choice([0, 0, 1, 1, 2, 4])):
                k = dice.randrange(len(own))
                own[k:k + dice.choice([0, 1, 1])] = [dice.choice(WORDS)]
            rows.append((len(rows), dice.choice([" ", "\n", " \t"]).join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_all_pairs(frame, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n"), (None, "a b c"), (1003, "A b C"), (1004, "a B c"), (5, "a b c"), (5, "a b c"), (1005, "x " * 5000), (1006, "X " * 6000)]
    docs = frame("doc_id long, text string, sign string", *[(*r, "x") for r in rows])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in as_dicts(jaccard.similar_groups(docs))), key=str)
    assert got == plain_components(rows)
    kept = as_dicts(jaccard.one_of_each(docs))
    named = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(named) == sorted({c for d, _, c in got if d is not None}) and len(kept) == len(named) + 1


def test_light_and_heavy_agree(frame, monkeypatch):
    rows = corpus(7, 12)
    docs = frame("doc_id long, text string", *rows)
    want = plain_components(rows)
    for light in (0, 14):
        monkeypatch.setattr(jaccard, "boundary", lambda *_, n=light: n)
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in as_dicts(jaccard.similar_groups(docs))), key=str)
        assert got == want


def test_sizes_of_subsets_and_prefixes():
    for a in range(1, 60):
        for b in range(a, 60):
            for both in range(a + 1):
                linked = 100 * both >= 80 * (a + b - both)
                assert linked == (both >= jaccard.required(a, b))
                if linked:
                    assert a - both < jaccard.prefix(a) and b - both < jaccard.prefix(b)


def test_sets():
    for text in ("a b c d e f", "A  b\tc d\x0be F", "a b", "", "x " * 40, "é É b c d e f\xa0g"):
        assert len(shingle_sets([text])[0]) == len(plain_set(text))
    assert np.array_equal(shingle_sets(["A B c d e f"])[0], shingle_sets(["zz", "a b C D e f"])[1])


def test_empty(frame):
    assert jaccard.similar_groups(frame("doc_id long, text string")).count() == 0


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.random(400) < rng.choice([0.3, 0.9, 0.99])], rng.integers(0, 1 << 62, int(rng.integers(0, 40))).astype(np.uint64))) for _ in range(60)]
    import pyarrow as pa

    class Rows:  # stands in for a table: the function of a task is run here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([s.tobytes() for s in sets])], ["sign", "data"])
            return list(run([batch]))[0].column(1).to_pylist()

    sketch = np.frombuffer(b"".join(jaccard._sketches(Rows())), np.uint8).reshape(60, -1)
    a, b = jaccard.possible_pairs(np.array([len(s) for s in sets]), np.arange(60), sketch, np.zeros(60), 80)
    possible, similar = set(zip(a.tolist(), b.tolist())), set()
    for i in range(60):
        for j in range(i + 1, 60):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                similar.add((i, j))
    assert similar and similar <= possible and len(possible) < 60 * 59 // 2
    a, b = jaccard.possible_pairs(np.array([len(s) for s in sets]), np.arange(60), sketch, np.zeros(60), 80, forest=True)
    assert len(a) < 60 and set(zip(a.tolist(), b.tolist())) <= possible
    def groups(edges):
        return sorted(zip(*(x.tolist() for x in local_components(*map(np.array, zip(*edges))))))
    assert groups(zip(a, b)) == groups(possible)
    halves = np.arange(60) % 2
    a, b = jaccard.possible_pairs(np.array([len(s) for s in sets]), np.arange(60), sketch, halves, 80)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in possible if halves[i] != halves[j]}


def test_a_common_passage_and_many_near_copies(frame, monkeypatch):
    """Lists of many sets, in several chunks, give the groups that comparing all pairs gives."""
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    dice = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(12))
    words = [f"w{i}" for i in range(300)]
    near = dice.choices(words, k=60)
    rows = []
    for i in range(90):
        if i % 3:
            rows.append((i, passage + " " + " ".join(dice.choices(words, k=dice.randint(3, 40)))))
        else:
            own = list(near)
            own[dice.randrange(60)] = f"x{i}"
            rows.append((i, " ".join(own)))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in as_dicts(jaccard.similar_groups(frame("doc_id long, text string", *rows)))), key=str)
    assert got == plain_components(rows)


def _rows_of_lists(sets):
    """The lists of one bucket that a task makes of sets, as pairs of sets that are in one list."""
    import pandas as pd

    signs = list(range(1, len(sets) + 1))
    made = jaccard._entries(signs, sets, jaccard.Ranks([]), 0, 80)
    blocks = list(jaccard._by_bucket(made[0], 1, *made))
    found = jaccard._lists(pd.DataFrame(blocks, columns=["bucket", "keys", "signs", "sizes", "kinds", "places"][:len(blocks[0])]))
    return {(a, b) for own in found.groupby("gid")["sign"].agg(list) for a in own for b in own if a < b}


def test_lists_leave_out_sets_without_a_possible_partner():
    small, large = np.arange(1, 41, dtype=np.uint64), np.append(np.uint64(1), np.arange(1000, 1200, dtype=np.uint64))
    assert _rows_of_lists([small, large]) == set()  # one common element, but sizes that never fit
    late = np.sort(np.append(np.arange(100, 108, dtype=np.uint64), np.arange(500, 550, dtype=np.uint64)))
    other = np.sort(np.append(np.uint64(107), np.arange(2000, 2057, dtype=np.uint64)))
    assert _rows_of_lists([late, other]) == set()  # what follows their common element is too little for 80 %


def test_linked_sets_stay_in_a_list():
    rng = np.random.default_rng(21)
    sets = []
    for size in (5, 30, 31, 200):
        base = rng.integers(0, 1 << 40, size)
        for share in (0.0, 0.02, 0.05, 0.1, 0.2):
            kept = base[rng.random(size) >= share]
            sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 40, max(1, int(share * size / 2))))).astype(np.uint64))
    pairs, linked = _rows_of_lists(sets), set()
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                linked.add((j + 1, i + 1))
    assert len(linked) > 10 and linked <= pairs


def test_texts_that_stay_are_not_shuffled(spark, frame):
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=40))) for i in range(60)]
    docs = frame("doc_id long, text string", *rows, *[(100 + i, rows[i][1]) for i in range(5)], rows[7], (None, rows[8][1]), (9, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.one_of_each(docs)
        plan = kept._jdf.queryExecution().executedPlan().initialPlan()
        found = sorted(((r["doc_id"], r["text"]) for r in as_dicts(kept)), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.nodeName() == "Union"
    assert "Exchange" not in plan.children().apply(0).toString() and "Exchange" in plan.children().apply(1).toString()
    assert found == sorted([*rows, (None, rows[8][1]), (9, None)], key=str)
