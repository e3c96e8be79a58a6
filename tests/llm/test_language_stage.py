"""The stage uses what the model says, and keeps documents where there is no model."""

from __future__ import annotations

import corpus_pipeline

from sparkbits.llm import language_id

from .conftest import SCHEMA


def test_no_language_known(spark):
    rows = [(1, "some text", None, "s", 9), (2, None, None, "s", None), (3, "12 !", None, "s", 4), (4, "é", None, "s", 1), (5, "", None, "s", 0)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_close_calls_go(spark, docs, monkeypatch):
    """The stage takes the model's answer: with a model that knows nothing every text is as close to one language as to another."""
    before = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert len(before) > 60
    trained = language_id.train

    def blank(rows):
        model = trained(rows)
        return model._replace(weights=model.weights * 0, bias=model.bias * 0)

    monkeypatch.setattr(language_id, "train", blank)
    assert corpus_pipeline.language(spark, docs, "").count() == 0
