import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lendlane.llm.token_counts import Counter, count_tokens
from tests.conftest import as_dicts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(
    [" ", "  ", "\n", " \n ", "\xa0", "\x85", "\x1c", "<|endoftext|>", " don't", "é", " 123", "😀", "　", "word ", " word", "!!", "a" * 90])), max_size=30)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_units(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert Counter(PATH).count(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(4, 40), st.integers(1, 12))
def test_chunks(parts, chunk, overlap):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert Counter(PATH, chunk, min(overlap, chunk - 1)).count(text) == library(text)


@pytest.mark.parametrize("text", ["x" * 5000 + " y" * 500, " " * 3000 + "a b " * 800, "日本語" * 900 + " k" * 50, "ab cd\n" * 2000])
def test_long_texts(text):
    assert Counter(PATH, 256, 16).count(text) == library(text)


def test_operator(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        frame("doc_id long, text string", (-1, None), (None, ""), (-2, "a b"), (-2, "a b"), (-3, "long text  here\n" * 9000)))
    rows = as_dicts(count_tokens(docs.selectExpr("doc_id", "text", "1 as n_tokens"), PATH))
    want = sorted((str(d["doc_id"]), len((d["text"] or "").encode()), library(d["text"] or "")) for d in as_dicts(docs))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert count_tokens(docs.limit(0), PATH).count() == 0
