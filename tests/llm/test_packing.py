import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lendlane.llm import packing, wordpieces
from lendlane.llm.wordpieces import word_encoder
from tests.conftest import as_dicts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "\n", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "It's", "É", "é", "12", "Σς", " ", "!!"])), max_size=12))
def test_ids_are_those_of_the_library(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    want = np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert word_encoder(PATH)([text, text]) == [want, want]


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_every_capacity_holds(choose):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 700)
    caps = packing.Capacities(tokens=128, pieces=4, cost=9000, weights=(1, .3, .3), choose=choose)
    lengths = np.minimum(lengths, 94)
    number, offset = packing.vector_best_fit(lengths, caps)
    for k in range(number.max() + 1):
        own = lengths[number == k]
        assert own.sum() <= 128 and len(own) <= 4 and (own ** 2).sum() <= 9000
        order = np.argsort(offset[number == k])
        assert list(offset[number == k][order]) == [0, *np.cumsum(own[order])[:-1]]


def test_few_sequences():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6, 1, 2000).astype(int) + 1, 2048)
    number, _ = packing.vector_best_fit(lengths, packing.Capacities())
    assert number.max() + 1 <= 1.01 * -(-lengths.sum() // 2048)


def test_operator(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = frame("doc_id long, text string, lang string", (-1, None, "a"), (-2, "", None), (None, "x y", "b"), (-3, "one two", "c"), (-3, "one two", "c"), (-4, "word " * 50000, "d"))
    docs = docs.unionByName(odd)
    rows = as_dicts(packing.pack_documents(docs, PATH))
    want = []
    for d in as_dicts(docs):
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            want.append((d["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= 1.05 * -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_groups(frame, spark):
    caps = packing.Capacities(tokens=64, pieces=64, cost=4096, group=50)
    parts = spark.range(2000).selectExpr("id as doc_id", "0 as piece", "0L as start", "id % 40 + 1 as length", "0L as ids_crc32")
    rows = as_dicts(packing.packed(parts, caps))
    assert len(rows) == 2000
    held = {}
    for r in rows:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    assert max(held.values()) <= 64 and len(held) <= 1.02 * -(-sum(held.values()) // 64)


def test_tasks_of_a_worker_share_the_words_it_has_met():
    encode = word_encoder(PATH)
    assert word_encoder(PATH) is encode
    text = "  Zebra zebra\x0bquux! \n"
    assert encode(["", text, " "]) == [b"", np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]


@pytest.mark.parametrize("caps", [{}, {"choose": "dot"}, {"pieces": 5, "weights": (1.0, .3, .3)}, {"cost": 2048 ** 2 + 10, "weights": (.1, 1.0, 1.0)}])
def test_the_sequence_chosen_is_the_best_of_all(caps):
    caps = packing.Capacities(**caps)
    lengths = np.minimum(np.random.default_rng(8).lognormal(5, 1.2, 400).astype(int) + 1, 2048)
    limit, weights, rooms, want = np.array([caps.tokens, caps.pieces, caps.cost], float), np.array(caps.weights), [], {}
    for item in np.argsort(-lengths, kind="stable"):
        size = np.array([lengths[item], 1, lengths[item] ** 2], float)
        def score(room):
            return weights @ ((room - size) / limit) ** 2 if caps.choose == "norm" else -(weights @ (room / limit * size / limit))
        fits = [k for k, room in enumerate(rooms) if (room >= size).all()]
        if not fits:
            rooms.append(limit.copy())
        k = min(fits, key=lambda k: (round(score(rooms[k]), 12), k)) if fits else len(rooms) - 1
        want[item] = k, caps.tokens - rooms[k][0]
        rooms[k] = rooms[k] - size
    number, offset = packing.vector_best_fit(lengths, caps)
    assert [(number[i], offset[i]) for i in range(400)] == [want[i] for i in range(400)]


class Counted:
    """A tokenizer that lists the words it is given."""
    given = []

    def __init__(self, inner):
        self.__dict__["inner"] = inner if isinstance(inner, Tokenizer) else Tokenizer(inner)

    @classmethod
    def from_file(cls, path):
        return cls(Tokenizer.from_file(path))

    def __getattr__(self, name):
        found = getattr(self.inner, name)
        if not name.startswith("encode"):
            return found

        def call(texts, **options):
            self.given.extend(" ".join([texts] if isinstance(texts, str) else texts).split())
            return found(texts, **options)
        return call

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)


def test_words_met_again_stay_known_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    monkeypatch.setattr(wordpieces, "MOST_WORDS", 6)
    monkeypatch.setattr(Counted, "given", [])
    word_encoder.cache_clear()
    try:
        for text, new in [("zebra quagga okapi dodo", "zebra quagga okapi dodo"), ("Zebra kakapo, dodo", "kakapo ,"), ("zebra dodo, quagga", "quagga")]:
            Counted.given.clear()
            assert word_encoder(PATH)([text]) == [np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
            assert sorted(Counted.given) == sorted(new.split())
    finally:
        word_encoder.cache_clear()


def test_letters_of_many_scripts():
    texts = [f"x{c}y {c} {c}!? A{c}{c}. {c}́ b{c}'s" for c in map(chr, range(1, 0x3000))] + ["Zoë ÉCOLE, naïve!", "ᄀ가각 한국어.", "ΣΟΦΟΣ σοφος,", "ŉ ǆ ﬁn"]
    assert word_encoder(PATH)(texts) == [np.array(e.ids, "<u4").tobytes() for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
