"""The pipeline: every stage against a brute-force version of its decision, and run() as a whole."""

import hashlib

import numpy as np
import pytest
from test_bpe import reference  # noqa: F401
from test_decontaminate import brute as brute_leaks
from test_jaccard import brute as brute_groups
from test_secrets import brute as brute_secrets

import corpus_pipeline as p
from muster.llm import quality

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[:5])
    assert 4 <= len(p.STAGES) <= 5


def test_quality_keeps_what_the_classifier_accepts(spark, steps):
    model = quality.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(steps[1]) == sorted((tuple(r) for r in steps[0].collect() if model.score(r.text) >= 0.7), key=repr)


def test_one_document_of_each_group_stays(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    kept = {d for d, n, c in brute_groups(before, 5, 80) if d == c or n == 0}
    assert rows(steps[2]) == sorted((tuple(r) for r in steps[1].collect() if r.doc_id in kept), key=repr)


def test_documents_with_benchmark_passages_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in steps[2].collect()], items)}
    assert leaks and rows(steps[3]) == sorted((tuple(r) for r in steps[2].collect() if r.doc_id not in leaks), key=repr)


def test_secrets_are_replaced_and_other_texts_stay(steps):
    after = {r.doc_id: r for r in steps[4].collect()}
    assert after.keys() == {r.doc_id for r in steps[3].collect()}
    for r in steps[3].collect():
        found = brute_secrets(r.text)
        if found:
            assert all(r.text[a:b] not in after[r.doc_id].text for _, a, b in found)
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        elif "[secret]" not in after[r.doc_id].text:
            assert after[r.doc_id] == r


def test_run_encodes_what_is_left(spark, steps, reference):  # noqa: F811
    expected = []
    for r in steps[4].collect():
        ids = np.asarray(reference.encode_ordinary(r.text), "<u4").tobytes()
        expected.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert rows(steps[5]) == sorted(expected, key=repr)
    assert rows(p.run(spark, SF)) == rows(steps[5])


def test_every_stage_takes_awkward_and_empty_tables(spark, make_docs):
    odd = make_docs([(1, None), (None, ""), (None, None), (2, "a b c"), (2, "a b c"), (3, "x " * 20_000)])
    for docs in (odd, make_docs([])):
        for _, stage in p.STAGES:
            stage(spark, docs, SF).collect()
    wide = make_docs([(1, "some words", "en", "s", 10, "x", 9)], ", _quality string, row long")
    for _, stage in p.STAGES[:4]:
        out = stage(spark, wide, SF)
        assert out.dtypes == wide.dtypes and all(r._quality == "x" for r in out.collect())
