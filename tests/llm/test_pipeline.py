"""The pipeline stage by stage against the operators' own verdicts."""

import corpus_pipeline
from holdfast.llm import decontaminate, jaccard, quality, toxicity
from holdfast.llm.common import stored, table


def test_stages_keep_what_their_operators_keep(spark, sf):
    docs, columns = table(spark, sf, "documents"), table(spark, sf, "documents").columns
    labels, benchmark = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, sf), name)
        assert kept.columns == columns
        verdict = {
            "quality_rules": lambda d: quality.quality(d, labels).where("kept"),
            "toxicity": lambda d: toxicity.toxicity(d, labels).where("score < 0.3"),
            "near_duplicates": lambda d: jaccard.components_of(d).where("doc_id = component_id"),
            "decontamination": lambda d: decontaminate.contamination(d, benchmark).where("not contaminated"),
        }[name]
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in verdict(docs).select("doc_id").collect())
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count() > 0


def test_driver_lets_go_of_each_stage(spark, sf, monkeypatch):
    stages = [("first", lambda s, docs, _: docs.where("doc_id % 2 = 0")), ("second", lambda s, docs, _: docs.where("doc_id % 3 = 0"))]
    released = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    monkeypatch.setattr(corpus_pipeline, "release", released.append, raising=False)
    out = corpus_pipeline.run(spark, sf)
    assert released == [spark, spark]
    assert out.count() == table(spark, sf, "documents").where("doc_id % 6 = 0").count() > 0
