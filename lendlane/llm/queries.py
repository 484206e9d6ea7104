"""The registered queries of the numbered operators, and the SQL they must agree with."""

from __future__ import annotations

import public_tokenizers

from lendlane.llm import (
    context_mixing, embeddings, jaccard, lexical, mixing, negatives, packing, pii, quality, repeats, token_counts,
    toxicity, word_classifier,
)
from lendlane.llm.shared import read_documents


def op1_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_pii(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    return pii.find_personal_data(docs, pii.fit(docs))


def op4_context_mixing(spark, sf_dir):
    return context_mixing.scored(read_documents(spark, sf_dir))


def op5_repeats(spark, sf_dir):
    return repeats.without_repeats(read_documents(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.judged(read_documents(spark, sf_dir), labels)


def op8_mixing(spark, sf_dir):
    mix = mixing.mix_documents(read_documents(spark, sf_dir, "doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard(spark, sf_dir):
    return jaccard.similar_groups(read_documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(read_documents(spark, sf_dir), labels)


def op11_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return negatives.hard_negatives(rows, negatives.ANCHORS, negatives.SHIFTED)


def op12_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return word_classifier.quality(read_documents(spark, sf_dir), labels)


def op13_search(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical.search(items, read_documents(spark, sf_dir))


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_context_mixing": op4_context_mixing,
    "op5_repeats": op5_repeats,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op9_jaccard": op9_jaccard,
    "op10_toxicity": op10_toxicity,
    "op8_mixing": op8_mixing,
    "op11_negatives": op11_negatives,
    "op12_classifier": op12_classifier,
    "op13_search": op13_search,
}

ORACLES = {
    "op8_mixing": mixing.ORACLE,
    "op11_negatives": negatives.ORACLE,
    "op13_search": lexical.ORACLE,
}
