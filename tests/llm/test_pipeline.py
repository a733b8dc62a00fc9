"""The pipeline's stages, one after the other, each held against what it promises."""

from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from glintframe.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_subsets(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    for a, b in zip(stages[:3], stages[1:4]):
        x, y = texts(a), texts(b)
        assert set(y.items()) <= set(x.items())


def test_toxic_documents_go(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = set(texts(stages[0])) - set(texts(stages[1]))
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert not gone & clean and len(gone & toxic) >= len(gone) / 2


def test_copies_go(stages):
    before, after = texts(stages[1]), texts(stages[2])
    best = {}
    for i, t in before.items():
        best[t] = max(i, best.get(t, -1))
    assert after == {i: t for t, i in best.items()}


def test_one_of_each_component_stays(stages):
    from tests.llm.test_operators import brute_components

    rows = list(texts(stages[2]).items())
    want = {i for i, _, c in brute_components(rows, 5, 80, 100) if i == c}
    assert set(texts(stages[3])) == want


def test_mix_comes_near_its_targets(stages):
    from glintframe.llm.mixing import targets

    words, got = Counter(), Counter()
    for r in stages[3].collect():
        words[r.source] += len(r.text.split())
    most = max(len(r.text.split()) for r in stages[3].collect())
    for r in stages[4].collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - t) <= most for s, t in targets(words).items())


def test_all_of_the_mix_is_packed(stages):
    from tests.llm.test_operators import check_packing

    check_packing([(r.doc_id, r.text) for r in stages[4].collect()], stages[5].collect())


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
