"""The pipeline's stages take effect, each on what the one before kept."""

import os
import re

import pytest

import corpus_pipeline
from tests.llm.plain import jaccard_groups, kept_bytes


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(os.path.join(folder, name))
        docs = spark.read.parquet(os.path.join(folder, name))
        out[name] = docs.collect() if name == "packing" else {r.doc_id: r for r in docs.collect()}
    return out


def test_language_names_all_that_have_letters(stages):
    want = {k for k, r in stages["documents"].items() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert set(stages["language"]) == want
    assert all(r.lang for r in stages["language"].values())


def test_one_of_each_group_stays(stages):
    before = {k: r.text for k, r in stages["language"].items()}
    assert set(stages["near_duplicates"]) == {k for k, c in jaccard_groups(before).items() if k == c}


def test_repeated_bytes_go(stages):
    before = {k: r.text for k, r in stages["near_duplicates"].items()}
    want = {k: b.decode("utf-8", "ignore") for k, b in kept_bytes(before).items()}
    assert {k: r.text for k, r in stages["repeated_passages"].items()} == want


def test_leaks_go_and_clean_documents_stay(spark, stages):
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for w in map(cut, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    before = stages["repeated_passages"]
    assert set(stages["benchmark_leaks"]) == {k for k, r in before.items() if not hit(cut(r.text))}
    assert len(stages["benchmark_leaks"]) < len(before)


def test_every_document_is_packed(stages):
    assert {r.doc_id for r in stages["packing"]} == set(stages["benchmark_leaks"])
