"""Texts, rows and column names made to break operators that hand whole rows on."""

import random

import pytest

from lendlane.llm import jaccard, mixing, repeats, shared, shingles, toxicity
from tests.conftest import as_dicts


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def twins(step=10, n=1024):
    """Two different texts that polynomial hashes modulo 2^64 cannot tell apart."""
    dice = random.Random(8)
    rest = ["".join(dice.choices("bcdefghij", k=step - 1)) for _ in range(n)]
    return ["".join("xy"[t ^ k] + r for t, r in zip(thue_morse(n), rest)) for k in (0, 1)]


def test_different_words_and_texts_stay_different(frame):
    a, b = twins()
    assert a != b and len(a) == 10240
    assert set(shingles.shingle_sets([a])[0].tolist()) != set(shingles.shingle_sets([b])[0].tolist())
    rows = as_dicts(repeats.without_repeats(frame("doc_id long, text string", (1, a), (2, b), (3, a), (4, "q" + b))), "doc_id")
    assert rows[1]["n_removed"] == rows[2]["n_removed"] == 0 and rows[3]["n_removed"] == 10240 and rows[4]["n_removed"] == 10240


def test_strings_that_hash_alike_are_compared():
    import numpy as np

    from lendlane.llm import suffixes

    data = np.frombuffer(b"abcdefgh" * 40 + b"abcdefgX" * 3, np.uint8)
    order = suffixes.suffix_array(data, 100)
    real = shared.PrefixHash.of
    try:
        shared.PrefixHash.of = lambda self, start, end: np.zeros(len(start), np.uint64)  # all hashes meet
        got = suffixes.common_prefixes(data, order, 20)
    finally:
        shared.PrefixHash.of = real
    want = suffixes.common_prefixes(data, order, 20)
    assert ((got == 20) == (want == 20)).all()


INNER = ["_id", "_hash", "_times", "_time", "_text", "_first", "_n", "_digest", "_key", "_copies", "_number", "_before", "_mine",
         "Score", "component", "sign", "digest", "doc", "size", "source_size", "target", "taken", "epochs", "node", "rank", "y", "key", "stays"]


@pytest.fixture
def documents(frame):
    texts = ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "one two three four five six seven", None, ""]
    rows = [(i, t, "en", "s", 7, *[f"{c}{i}" for c in INNER]) for i, t in enumerate(texts)]
    return frame("doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in INNER), *rows)


def test_stages_hand_every_column_on(frame, documents):
    labels = frame("doc_id long, toxic int", (0, 0), (1, 0))
    own = {r["doc_id"]: r for r in as_dicts(documents)}
    for stage in (lambda d: toxicity.without_toxic(d, labels), jaccard.one_of_each, mixing.repeated):
        got = stage(documents)
        assert got.columns == documents.columns
        rows = as_dicts(got)
        assert rows and all(r == own[r["doc_id"]] for r in rows)


def test_one_of_each_decides_by_text(frame):
    """Twenty ids that each stand on a copy and on a text of their own: no text is lost, no needless copy stays."""
    copy = "the same words in every one of these rows"
    rows = [(i, copy) for i in range(20)] + [(i, f"row {i} has its own words {i} here") for i in range(20)]
    rows += [(3, rows[23][1]), (None, copy), (None, copy), (50, " "), (50, " "), (51, None)]
    for docs in (frame("doc_id long, text string", *rows), frame("doc_id long, text string", *rows).repartition(3)):
        got = sorted(((r["doc_id"], r["text"]) for r in as_dicts(jaccard.one_of_each(docs))), key=str)
        assert got == sorted([(0, copy), *rows[20:40], (None, copy), (None, copy), (50, " "), (50, " "), (51, None)], key=str)


def test_equal_rows_share_their_copies(frame):
    """The table holds the words the mix takes, whatever the rows repeat."""
    rows = [(i % 4, "a b c" if i % 4 else "a b c d e f g", "s1", i % 2) for i in range(30)] + [(100 + i, "x y", "s2", 0) for i in range(40)] + [(None, "n n n", "s3", 1)] * 3
    docs = frame("doc_id long, text string, source string, flag int", *rows)
    mix = as_dicts(mixing.mix_documents(docs))
    taken, epochs = sum(r["taken"] for r in mix), sum(r["epochs"] for r in mix)
    got = as_dicts(mixing.repeated(docs))
    assert len(got) == epochs and sum(len(r["text"].split()) for r in got) == taken
    for source in ("s1", "s2", "s3"):
        words = sum(len(r["text"].split()) for r in got if r["source"] == source)
        target = {r["target"] for r in mix if (r["source_size"], r["target"]) and r["doc_id"] in {x[0] for x in rows if x[2] == source}}
        assert len(target) == 1 and abs(words - target.pop()) <= 7
    counts = {}
    for r in got:
        key = (r["doc_id"], r["flag"])
        counts[key] = counts.get(key, 0) + 1
    assert set(counts) <= {(x[0], x[3]) for x in rows}
