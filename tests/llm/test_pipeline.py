"""The pipeline, stage by stage, against what each stage's operator says of its input."""

from collections import Counter

import pytest

import corpus_pipeline
from castloom.llm import mixing, pii, quality, simhash
from castloom.llm.base import parked
from tests.llm.cases import documents, empty
from tests.oracle import ROOT

FOLDER = str(ROOT / "sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(parked(stage(spark, out[-1], FOLDER), name.replace(" ", "-")))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(results):
    docs, kept, unique, clean, mix, encoded = results
    assert all(df.columns == COLUMNS for df in results[:-1])
    assert ids(kept) == ids(quality.judge(docs).where("kept"))
    components = simhash.near_duplicates(kept, words=5).collect()
    assert ids(unique) == Counter({r["component_id"] for r in components})
    assert ids(clean) == ids(unique)
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    model = pii.fit(unique)
    for r in clean.collect():
        assert r["text"] == pii.redacted(before[r["doc_id"]], pii.find([before[r["doc_id"]]], model)[0][1])
        assert r["n_chars"] == len(r["text"])
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(clean).where("size > 0").collect()}
    for doc, n in ids(mix).items():
        assert abs(n - taken[doc]) <= 0.5
    assert sum(ids(mix).values()) == pytest.approx(sum(taken.values()), abs=10)
    assert ids(encoded) == ids(mix)
    assert encoded.where("not parity or not round_trip").count() == 0


def test_run(spark, results):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, results[-1].collect()))


def test_odd_documents_and_none(spark):
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = parked(stage(spark, docs, FOLDER), "stage")
        docs.collect()
