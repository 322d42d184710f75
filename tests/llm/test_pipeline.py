"""The corpus pipeline, stage by stage and whole."""

import os

import pytest

import corpus_pipeline
from keyweave.llm import langid, minhash, mixing, quality

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], (_identified, _clean, _first, _mixed)):
        after = stage(spark, docs, DIR)
        assert after.columns == columns, name
        assert sorted(r.doc_id for r in after.collect()) == expected(docs), name
        docs = after
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(r.doc_id for r in docs.collect())
    whole = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tokens.collect()))


def _identified(docs):
    return sorted(r.doc_id for r in langid.identify(docs, langid.train(docs)).filter("kept").collect())


def _clean(docs):
    return sorted(r.doc_id for r in quality.quality(docs).filter("kept").collect())


def _first(docs):
    return sorted(r.doc_id for r in minhash.near_duplicates(docs).filter("kept").collect())


def _mixed(docs):
    return sorted(r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies))
