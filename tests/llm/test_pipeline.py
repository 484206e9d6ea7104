import re

import pytest

import corpus_pipeline
from lendlane.llm import mixing, pii
from tests.conftest import as_dicts
from tests.llm.test_jaccard import plain_components
from tests.llm.test_mixing import reference_targets
from tests.llm.test_pii import plain as plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, read, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((read, name))
        stage(spark, read, SF).write.parquet(f"{folder}/{name}")
        read = spark.read.parquet(f"{folder}/{name}")
    return [df for df, _ in out] + [read]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "pii", "mixing", "packing"]


def test_toxic_ones_go(stages, spark):
    toxic = {r["doc_id"] for r in as_dicts(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1"))}
    before, after = ({r["doc_id"] for r in as_dicts(df)} for df in stages[:2])
    assert after <= before and len(before - after - toxic) <= 0.08 * len(before)


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in as_dicts(stages[1])]
    assert {r["doc_id"] for r in as_dicts(stages[2])} == {c for _, _, c in plain_components(rows)}


def test_no_personal_data_is_left(stages):
    before, after = (as_dicts(df, "doc_id") for df in stages[2:4])
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert not pii.base_spans(after[i]["text"] or "") and after[i]["n_chars"] == len(after[i]["text"])
        if not re.search("[0-9@]", r["text"] or ""):
            assert after[i] == r
        for a, b, _ in plain_spans(r["text"] or ""):
            assert r["text"][a:b] not in after[i]["text"]


def test_mix(stages):
    before, after = as_dicts(stages[3], "doc_id"), as_dicts(stages[4])
    taken, sizes = {}, {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for r in after:
        assert r == before[r["doc_id"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert taken == {r["doc_id"]: r["epochs"] for r in as_dicts(mixing.mix_documents(stages[3])) if r["epochs"]}
    assert max(taken.values()) <= 3 and set(reference_targets(sizes)) == set(sizes)


def test_packed(stages):
    copies, pieces = {}, as_dicts(stages[5])
    for r in as_dicts(stages[4]):
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    first, used = {}, {}
    for r in pieces:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        if r["piece"] == 0:
            first[r["doc_id"]] = first.get(r["doc_id"], 0) + 1
    assert first == copies and max(used.values()) <= 2048


def test_run(spark, stages):
    def key(r):
        return r["doc_id"], r["piece"], r["ids_crc32"]

    assert sorted(map(key, as_dicts(corpus_pipeline.run(spark, SF)))) == sorted(map(key, as_dicts(stages[5])))
