"""Each pipeline stage against a brute-force version of it, on the stage's own input."""

import pytest

import corpus_pipeline
from cachelens.llm import common as C
from cachelens.llm import toxicity
from tests.llm.test_llm_operators import brute_components, brute_cut, words
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before and after each stage."""
    docs, out = C.documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        after = C.materialise(stage(spark, docs, sf_dir), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert tuple(after.columns) == C.DOCUMENT_COLUMNS, name


def test_toxicity(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    net = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r["doc_id"]: r["toxicity"] for r in toxicity.with_toxicity(before, net).collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if score[i] < toxicity.THRESHOLD}


def test_near_duplicates(stages):
    before, after = map(texts, stages["near_dedup"])
    assert after == {i: before[i] for i, (_, first) in brute_components(before, 80).items() if i == first}


def test_substrings(stages):
    before, after = map(texts, stages["substring_dedup"])
    import hashlib

    want = brute_cut(before)
    assert before.keys() == after.keys()
    for i, (_, gone, digest) in want.items():
        assert hashlib.sha256(b" ".join(words(after[i]))).hexdigest() == digest
        assert gone or after[i] == before[i]


def test_decontamination(spark, sf_dir, stages):
    before, after = map(texts, stages["decontamination"])
    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {i for i, t in before.items() if any(x in plain(t) for x in items)}
    assert not whole & after.keys() and all(before[i] == t for i, t in after.items())
    # what goes shares a third of an item's word windows with it
    grams = [{tuple(x.split()[k : k + 8]) for k in range(len(x.split()) - 7)} for x in items]
    for i in before.keys() - after.keys() - whole:
        w = plain(before[i]).split()
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        assert any(g and len(g & own) >= 0.2 * len(g) for g in grams), i


def test_packing(stages):
    before, after = stages["packing"]
    assert check([r.asDict() for r in after.collect()], texts(before)) < 0.01


def test_run_equals_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() == stages["packing"][1].count()
