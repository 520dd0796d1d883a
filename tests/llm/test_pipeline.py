"""The pipeline's stages on a small table, each against its operator's rule."""

import re

import corpus_pipeline
from anamnesis.llm import pii, quality
from anamnesis.llm.queries import QUERIES
from test_copies import near_classes


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, small).write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert seen[name].columns == docs.columns
        before = seen[name]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["quality"] == {r.doc_id for r in quality.verdicts(docs).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in seen["quality"].collect()}
    name = near_classes(texts)
    kept = ids["near_dedup"]
    # Each kept row is the least of its class, and few classes are seen as two.
    assert set(name.values()) <= kept and len(kept) <= 1.02 * len(set(name.values()))
    assert ids["pii"] == ids["near_dedup"]
    raw = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    for r in seen["pii"].collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", raw[r.doc_id]):
            assert r.text == raw[r.doc_id]
    assert ids["mixing"] <= ids["pii"] and len(ids["mixing"]) > 0.6 * len(ids["pii"])
    assert ids["sentencepiece"] == ids["mixing"] and seen["sentencepiece"].count() == len(ids["mixing"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).select("doc_id").collect()} == ids["mixing"]


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
