"""The pipeline's stages: what each takes away goes, and all else stays."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import decontam, neardup, toxicity
from tidemark.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.fit(toxicity.labelled(docs, table(spark, SF, "labels"))))
            assert after == {r.doc_id for r in scores.where("score < 0.5").collect()}
        elif name == "near_duplicates":
            assert after == {r.doc_id for r in neardup.near_duplicates(docs, neardup.Settings(words=5)).where("kept").collect()}
        elif name == "decontamination":
            assert before - after == {r.doc_id for r in decontam.find(docs, table(spark, SF, "benchmark")).collect()}
        else:
            assert after == before
        before, docs = after, out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id: r.text for r in last.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_stages_take_odd_rows_and_none(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "one two", "en", "s", 7), (2, "one two", "en", "s", 7), (None, "three four", None, "s", 10), (5, "one two", None, "s", 7)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.withColumns({"label": docs["doc_id"], "id": docs["doc_id"]})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        kept = stage(spark, extra, SF).collect()
        assert len(kept) == (5 if name == "near_duplicates" else 6), name
